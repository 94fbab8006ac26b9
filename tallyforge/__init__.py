"""tallyforge: review scoring, entity resolution and publication as Spark DataFrame programs."""
