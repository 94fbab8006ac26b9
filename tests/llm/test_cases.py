"""Nulls, empty and repeated rows, clashing columns: every operator gives its defined result."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import chunking, decontaminate, langid, ngram, packing, privacy, probminhash, repair, toxicity
from tests.llm.helpers import docs

TEXTS = [
    (1, "the cat sat on the mat and the dog ran off"), (2, None), (3, ""), (4, "the cat sat on the mat and the dog ran off"),
    (None, "le chat noir est parti"), (5, "x" * 3000), (6, "123 !!"), (6, "123 !!"), (7, "word " * 4000),
]
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def clashing(frame):
    """Extra columns that are named like those the operators make."""
    names = ("score", "lang_pred", "key", "node", "bands", "spans", "start", "length", "seed", "place", "ids", "shard", "block", "verdict", "n", "toxic")
    return frame.withColumns({n: F.lit("extra") for n in names})


def labels(spark, rows=((1, 1, 1), (4, 0, None), (None, 1, 1), (7, 1, 0))):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("other"))


OPERATORS = {
    "repair": lambda s, d: repair.read_shards(repair.write_shards(d, WORD)),
    "toxicity": lambda s, d: toxicity.toxicity(d, labels(s)),
    "chunking": lambda s, d: chunking.media(d),
    "langid": lambda s, d: langid.language(d),
    "ngram": lambda s, d: ngram.perplexity(d),
    "probminhash": lambda s, d: probminhash.classes(d),
    "packing": lambda s, d: packing.pack(packing.cut(d, BYTE, 1)),
    "privacy": lambda s, d: privacy.digest(privacy.find(d)),
    "sanitise": lambda s, d: privacy.sanitise(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_are_kept(spark, name):
    got = OPERATORS[name](spark, clashing(docs(spark, TEXTS))).select("doc_id").distinct().count()
    assert got == 8


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, docs(spark, [])).collect() == []


def test_decontaminate_cases(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, "a b c d e f g"), (4, "too few words")], "item_id long, text string")
    rows = [*TEXTS, (8, "so " + item.upper() + " end"), (9, "A, b! c d e f g"), (10, "too few words")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(clashing(docs(spark, rows)), items.withColumn("h", F.lit(1))).collect()}
    assert got == {(8, 1), (9, None)}
    assert decontaminate.matches(docs(spark, rows), items.where("false")).collect() == []
    left = decontaminate.clean(clashing(docs(spark, rows)), items)
    assert left.count() == len(rows) - 2


def test_pipeline_stages_take_clashing_columns(spark):
    d = clashing(docs(spark, TEXTS))
    out = corpus_pipeline.language(spark, d, "")
    assert out.columns == d.columns and out.where("doc_id in (2, 3, 6)").count() == 0
    assert probminhash.one_of_each(d).count() == 6  # distinct texts, none similar
    assert privacy.sanitise(d).columns == d.columns
