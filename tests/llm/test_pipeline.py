"""The stages, one after the other, on documents whose fate is known."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.helpers import docs
from tests.llm.test_probminhash import brute


def test_run(spark, tmp_path):
    r = np.random.default_rng(8)
    words = lambda n: " ".join(f"wort{x}" for x in r.integers(0, 3000, n))
    item = words(40)
    rows = [(i, words(60), ["en", "de"][i % 2]) for i in range(60)]
    rows += [(100 + k, rows[k][1], "en") for k in range(5)]  # equal texts
    rows += [(200 + k, rows[k][1] + " zusatz", "en") for k in range(5, 10)]  # near ones
    rows += [(300, words(10) + " " + item[: len(item) // 2] + " " + words(10), "de"), (301, item.upper(), "en")]
    rows += [(400, None, "en"), (401, "12 34 !!", "en"), (402, "", None)]
    rows += [(500, words(20) + " mail a.b@example.org now", "en")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    letters = [(i, t) for i, t, _ in rows if t and any(c.isalpha() for c in t)]
    one_each = set(brute(letters).values())
    kept = {i: t for i, t in letters if i in one_each and i not in (300, 301)}
    assert {x.doc_id for x in out} == set(kept)
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    for i, t in kept.items():
        ids = encode(t.replace("a.b@example.org", "[EMAIL]"), add_special_tokens=False).ids + [1]
        own = sorted((x for x in out if x.doc_id == i), key=lambda x: x.start)
        assert {x.doc_tokens for x in own} == {len(ids)} and sum(x.length for x in own) == len(ids)
        assert np.frombuffer(b"".join(x.ids for x in own), "<u4").tolist() == ids


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "near duplicates", "benchmark decontamination", "personal data", "packing"]


def test_language_without_a_model_keeps_texts_with_letters(spark):
    import corpus_pipeline
    from tests.llm.helpers import docs

    rows = [(1, "clean text", None), (2, "123 !", None), (3, None, None), (4, "\u00e9", None)]
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs(spark, rows), "").collect()) == [1, 4]


def test_the_network_decides(spark):
    """A text of three languages in equal parts is rejected, and a missing lang is filled in."""
    r = np.random.default_rng(2)
    say = lambda letters, n: "".join(r.choice(list(letters), n))
    tongues = {"one": "abcd ", "two": "mnop ", "three": "vwxy "}
    rows = [(3 * i + k, say(letters, 600), lang) for i in range(80) for k, (lang, letters) in enumerate(tongues.items())]
    rows += [(900, "".join("a" + say(letters, 191) for letters in tongues.values()), "one"), (901, say("vwxy ", 900), None)]
    got = {x.doc_id: x.lang for x in corpus_pipeline.language(spark, docs(spark, rows), "").collect()}
    assert 900 not in got and got == {i: lang or "three" for i, _, lang in rows if i != 900}


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs(spark, []), str(tmp_path)).collect() == []
