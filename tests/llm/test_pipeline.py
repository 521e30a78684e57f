"""Each stage of the pipeline on what its predecessor kept, against plain versions."""

import collections

import duckdb

import corpus_pipeline
from tests.llm import plain
from trackflux.llm import mixing


def test_stages(spark, sf_dir, tmp_path):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = df.columns
    tables, frames = [], []
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in df.select("doc_id", "text").collect()]
        out = stage(spark, df, sf_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "pack":
            assert df.columns == columns
        after = [tuple(r) for r in df.select("doc_id", *(["text"] if name != "pack" else ["doc_tokens"])).collect()]
        tables.append((before, after))
        frames.append(df)
    count = lambda rows: collections.Counter(rows)
    (b0, a0), (b1, a1), (b2, a2), (b3, a3), (b4, a4) = tables
    assert count(a0) == count(r for r in b0 if plain.passes(r[1])[1])
    assert count(a1) == count({t: (k, t) for (_, t), (_, k, _, _, _) in zip(b1, plain.exact(b1))}.values())
    assert count(a2) == count({r for r, g in zip(b2, plain.near_groups(b2)) if g[3]})
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/near_dedup/*.parquet')")
    taken = collections.Counter()
    for i, n in con.execute(f"SELECT doc_id, CASE WHEN size > 0 THEN taken // size ELSE 0 END FROM ({mixing.SQL})").fetchall():
        taken[i] += n
    assert count(i for i, _ in a3) == +taken
    assert len(b4) == len(a3) and {i for i, _ in a4} == {i for i, _ in b4}
