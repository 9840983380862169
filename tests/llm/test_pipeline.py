import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexigrid.llm import line_dedup, mixing, packing, quality, registry, simhash, token_store

from .helpers import documents, words
from .test_line_dedup import brute as brute_lines
from .test_mixing import brute as brute_mix
from .test_packing import brute as brute_pack
from .test_quality import brute_cut, brute_model, brute_nll, folds
from .test_simhash import brute_groups, edited

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    """Each stage on a planted corpus: what it must drop goes, clean documents stay."""
    rng = random.Random(11)
    clean = [(i, "\n".join(words(rng, 12, "abcdef") for _ in range(6)), "en", f"s{i % 12}") for i in range(120)]
    junk = [(500 + i, words(rng, 60, "xyz#%"), "en", "s0") for i in range(10)]
    footer = "made with care by the same tool everywhere"
    rows = [(i, t + "\n" + footer if i // 12 % 2 else t, lang, s) for i, t, lang, s in clean] + junk  # on all twelve sites
    rows += [(700 + i, rows[i][1] + " edited", "en", "s3") for i in range(8)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1 if i < 500 else 0, 0) for i in [*range(100), 500, 501]], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        path = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = lambda name: {r["doc_id"] for r in seen[name].select("doc_id").collect()}
    assert not {r[0] for r in junk} & ids("quality") and len(ids("quality") & set(range(120))) >= 117
    assert ids("line dedup") == ids("quality") and seen["line dedup"].where(f"contains(text, '{footer}')").count() == 0
    assert not {*range(700, 708)} & ids("near dedup") and ids("near dedup") == ids("line dedup") - {*range(700, 708)}
    assert ids("packing") == ids("mixing") < ids("near dedup")
    total = {n: seen[n].select(token_store.token_count(spark, F.col("text")).alias("n")).selectExpr("sum(n)").first()[0] for n in ("near dedup", "mixing")}
    assert 0.45 * total["near dedup"] < total["mixing"] <= 0.5 * total["near dedup"]
    assert seen["packing"].selectExpr("sum(n_tokens)").first()[0] == total["mixing"]
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, seen["packing"].collect()))


def brute_quality(rows, trusted, fold):
    p, seen, cuts = brute_model([t for i, t, *_ in rows if i in trusted and t], quality.ORDER), {}, {}
    for lang in {r[2] for r in rows if r[0] in trusted}:
        cuts[lang] = brute_cut(rows, trusted, fold, lang, quality.QUANTILE)
    return [r for r in rows if r[1] and (r[2] not in cuts or brute_nll(p, r[1], seen) <= cuts[r[2]])]


def test_run_against_brute_force(spark, tmp_path):
    rng = random.Random(21)
    vocabulary, footer = words(rng, 40, "abcdef").split(), "the same last line on every site"
    text = lambda i: "\n".join(" ".join(rng.choices(vocabulary, k=9)) for _ in range(4)) + ("\n" + footer if i % 2 else "")
    rows = [(i, text(i), "en", f"s{i // 2 % 11}") for i in range(66)] + [(400 + i, text(i), "de" if i < 40 else "fr", f"src{i % 4}") for i in range(50)]
    rows += [(100 + i, edited(rng, rows[3 * i][1].replace(footer, "").strip(), 0.03), "en", f"s{i % 5}") for i in range(9)]
    rows += [(200 + i, words(rng, 25, "xyz#%"), "en", "s0") for i in range(6)] + [(300, None, "en", "s1"), (301, "", None, "s2"), (302, rows[2][1], "en", None), (303, rows[2][1], "en", "s4"), (304, text(0), None, "s5")]
    trusted = {*range(40), *range(400, 430), *range(440, 445)}
    documents(spark, rows, clash=True).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i in trusted), 0) for i in [*sorted(trusted), *range(200, 206)]], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    good = brute_quality(rows, trusted, folds(spark))
    lines = [r[:4] for r in brute_lines(good, line_dedup.MIN_SITES)]
    groups = brute_groups([r[1] for r in lines])
    least: dict[int, int] = {}
    for g, r in zip(groups, lines):
        least[g] = min(least.get(g, r[0]), r[0])
    single = [r for g, r in zip(groups, lines) if least[g] == r[0]]
    encode, id_bytes = token_store.tokenizer(token_store.TOKENIZER)
    mixed = brute_mix(single, mixing.TARGET_WEIGHTS, n=lambda t: len(encode([t or ""])[0]) // id_bytes)
    assert len(rows) > len(good) > len(single) > len(mixed) > 10 and good != lines
    order = sorted(mixed, key=lambda r: (-r[2], r[0]))
    want, filled = [], {}
    for r, b in zip(order, brute_pack([r[2] for r in order], (packing.CAPACITY_TOKENS, packing.CAPACITY_DOCS, packing.CAPACITY_ATTENTION), packing.WEIGHTS, "norm")):
        want.append((b, filled.get(b, 0), r[0], 0, 0, r[2]))
        filled[b] = filled.get(b, 0) + 1
    got = corpus_pipeline.run(spark, str(tmp_path)).select("bin_id", "slot", "doc_id", "piece", "start_token", "n_tokens").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty_tables(spark, tmp_path):
    documents(spark, [], clash=True).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables aren't here")
@pytest.mark.parametrize("name", list(registry.queries()))
def test_queries(spark, name):
    import glob

    import duckdb

    got = registry.queries()[name](spark, SF).toPandas()
    assert len(got)
    sql = registry.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for p in glob.glob(f"{SF}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
        want = con.execute(sql).df()
        key = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
        assert key(got) == key(want)


def test_near_dedup_spreads_its_pairs_of_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MIN_TILES", 4)
    rng = random.Random(6)
    base = words(rng, 300).split()
    texts = []
    for _ in range(60):
        w = list(base)
        for at in rng.sample(range(300), 4):
            w[at] = words(rng, 1)
        texts.append(" ".join(w))
    texts.append(words(rng, 80))
    docs, seen = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), []
    edges = simhash._edges
    monkeypatch.setattr(simhash, "_edges", lambda *a: seen.append(edges(*a)) or seen[-1])
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()) == [0, 60]
    filled = [len(p) for p in seen[0].rdd.glom().collect()]
    assert len(filled) == 10 and min(filled) > 0
