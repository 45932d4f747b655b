"""The pipeline's stages on a small table, each against what must come out by definition."""

import random

import corpus_pipeline as cp
from test_jaccard import brute
from test_line_dedup import expected

STAGES = dict(cp.STAGES)


def rows():
    rnd = random.Random(11)
    vocab = {"en": [f"{a}ing{b}" for a in "bcdfg" for b in "aeiou"], "de": [f"{a}ung{b}" for a in "hklmn" for b in "aeiou"]}
    out = []
    for k in range(40):
        lang = "en" if k % 3 else "de"
        words = [rnd.choice(vocab[lang]) for _ in range(60)]
        out.append((k, " ".join(words[:20]) + "\n" + " ".join(words[20:]), lang, f"s{k % 4}"))
    near = out[3][1].split(" ")
    near[5] = "changed"
    shared = " ".join(rnd.choice(vocab["en"]) for _ in range(15))
    out += [(50, " ".join(near), "en", "s1"), (51, out[7][1] + "\n" + shared, "en", "s2"), (52, out[8][1] + "\n" + shared, "en", "s3")]
    return out + [(60, None, "en", "s1"), (61, "", None, "s1"), (62, "12 34 --", "en", "s2"), (63, "\n".join([out[1][1]] * 2), None, None)]


def test_stages(spark):
    data = rows()
    schema = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame(data, schema).selectExpr("*", "cast(length(text) as int) as n_chars", "1 as removed", "2 as maybe_", "3 as epoch").repartition(3)
    text = {r[0]: r[1] for r in data}
    one = STAGES["language ID"](spark, docs, "").cache()
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == set(text) - {60, 61, 62}
    two = STAGES["line dedup"](spark, one, "").cache()
    gone = expected([(r.doc_id, r.text) for r in one.collect()])
    want = {}
    for i in set(text) - {60, 61, 62}:
        kept = "\n".join(x for k, x in enumerate(text[i].split("\n")) if k not in gone.get(i, []))
        if kept.strip() or not gone.get(i):
            want[i] = kept
    got = {r.doc_id: r for r in two.collect()}
    assert two.columns == docs.columns and {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) and r.removed == 1 for r in got.values())
    three = STAGES["n-gram Jaccard join"](spark, docs, "").cache()
    assert {r.doc_id for r in three.collect()} == {i for i, _, c in brute([(r[0], r[1]) for r in data]) if i == c}
    four = STAGES["mixing to target weights"](spark, two, "").cache()
    tokens = lambda rs: sum(len(r.text.split()) for r in rs)
    mixed = four.collect()
    assert four.columns == docs.columns and len({r.doc_id for r in mixed}) == len(mixed)
    assert 0.5 * tokens(got.values()) < tokens(mixed) <= 0.9 * tokens(got.values())
    five = STAGES["best-fit packing"](spark, four, "").collect()
    assert {r.doc_id for r in five} == {r.doc_id for r in mixed}
    assert len({r.sequence_id for r in five}) == -(-sum(r.length for r in five) // 4096)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0 and (name == "best-fit packing" or out.columns == docs.columns)
