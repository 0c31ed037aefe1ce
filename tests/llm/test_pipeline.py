"""The pipeline against the plain versions of its stages."""

from collections import Counter

import corpus_pipeline as cp
from colloquy.llm import catalog
from colloquy.llm.tokens import default_tokenizer
from tests.llm import plain

SMALL = "/root/testdata/sf0.001"


def test_each_stage_does_its_work(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality_rules", "near_dedup", "decontamination", "source_mixing", "token_output"]
    rows = lambda df: [tuple(r) for r in df.select("doc_id", "text").collect()]

    stages = dict(cp.STAGES)
    kept = stages["quality_rules"](spark, docs, SMALL).cache()
    verdict = {r.doc_id for r in catalog.queries()["op5_quality_rules"](spark, SMALL).where("kept").collect()}
    assert {i for i, _ in rows(kept)} == verdict and kept.columns == columns

    single = stages["near_dedup"](spark, kept, SMALL).cache()
    groups = plain.near_duplicates(rows(kept))
    assert sorted(i for i, _ in rows(single)) == sorted(i for i, (_, c) in groups.items() if i == c) and single.columns == columns

    clean = stages["decontamination"](spark, single, SMALL).cache()
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    leaked = {i for i, _ in plain.leaks(rows(single), items)}
    assert sorted(i for i, _ in rows(clean)) == sorted(i for i, _ in rows(single) if i not in leaked) and clean.columns == columns

    mixed = stages["source_mixing"](spark, clean, SMALL).cache()
    assert mixed.columns == columns and max(Counter(i for i, _ in rows(mixed)).values()) <= 2
    words = lambda df: sum(len(plain.WORD.findall(t)) for _, t in rows(df))
    assert abs(words(mixed) / words(clean) - 1.5) < 0.15

    out = [tuple(r) for r in stages["token_output"](spark, mixed, SMALL).orderBy("start").collect()]
    assert out == plain.token_rows(sorted(rows(mixed)), default_tokenizer())
    assert out == [tuple(r) for r in cp.run(spark, SMALL).orderBy("start").collect()]


def test_odd_rows(spark, odd_dir, odd_rows):
    """Nulls, blank texts, repeated rows and columns of clashing names, stage by stage."""
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    columns, stages = docs.columns, dict(cp.STAGES)
    rows = lambda df: sorted((tuple(r) for r in df.select("doc_id", "text").collect()), key=repr)
    kept = stages["quality_rules"](spark, docs, odd_dir).cache()
    long = [(r[0], r[1]) for r in odd_rows if len(plain.WORD.findall(r[1] or "")) >= 50]
    assert kept.columns == columns and set(rows(kept)) <= set(long) and {1, 2, 3, 4, None} <= {i for i, _ in rows(kept)}
    single = stages["near_dedup"](spark, kept, odd_dir).cache()
    assert single.columns == columns
    of = {i: c for i, (_, c) in plain.near_duplicates(rows(kept)).items()}
    assert sorted(i for i, _ in rows(single) if i is not None) == sorted(set(of.values()))
    clean = stages["decontamination"](spark, single, odd_dir).cache()
    items = [tuple(r) for r in spark.read.parquet(f"{odd_dir}/benchmark.parquet").select("item_id", "text").collect()]
    leaked = {i for i, _ in plain.leaks(rows(single), items)}
    assert clean.columns == columns and rows(clean) == [r for r in rows(single) if r[0] not in leaked] and 8 in leaked
    mixed = stages["source_mixing"](spark, clean, odd_dir).cache()
    assert mixed.columns == columns and set(rows(mixed)) <= set(rows(clean)) and max(Counter(rows(mixed)).values()) <= 2
    out = stages["token_output"](spark, mixed, odd_dir).collect()
    want = {(i, n, c) for i, _, n, c in plain.token_rows(rows(mixed), default_tokenizer())}
    assert len(out) == mixed.count() and {(r.doc_id, r.n_tokens, r.ids_crc32) for r in out} == want
    assert cp.run(spark, f"{odd_dir}/empty").collect() == []


def test_wholly_repeated_rows_are_mixed_one_by_one(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (2, "e f g", "x"), (None, "h i", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    n = Counter(tuple(r) for r in dict(cp.STAGES)["source_mixing"](spark, df, "").collect())
    assert set(n) <= set(rows) and n[rows[0]] <= 4 and n[rows[2]] <= 2 and n[rows[3]] <= 2


def test_rows_that_share_a_doc_id_are_judged_each_by_its_text(spark):
    from colloquy.llm.decontaminate import decontaminate

    words = lambda name, n: [f"{name}{k}" for k in range(n)]
    item = " ".join(words("item", 40))
    clean = [(None, " ".join(words("a", 60))), (7, " ".join(words("b", 60)))]
    rows = [*clean, (None, f"before {item} after"), (7, f"{item} after")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate(frame(rows), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, clean))

    near = lambda name, k: " ".join([*words(name, 100), f"end{k}"])
    rows = [(None, near("c", 1)), (None, near("c", 2)), (5, near("d", 1)), (5, near("e", 1)), (None, near("d", 2)), (9, near("e", 2)), (3, near("e", 3)), (5, None), (None, "")]
    got = {tuple(r) for r in dict(cp.STAGES)["near_dedup"](spark, frame(rows), "").collect()}
    assert len(got) == 5 and {(5, near("d", 1)), (3, near("e", 3)), (5, None), (None, "")} < got
