import os
import random

import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, kept string"


def odd_rows(texts):
    """Nulls, empty and long texts, ties, repeated rows, groups of exact and near copies, shared passages."""
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(3000)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, hub = prose(40), prose(300)
    rows = [(1000, None), (1001, ""), (1002, " \n\t\x0b "), (1003, "One two three"), (1003, "One two three"), (1004, "one TWO three"), (None, texts[7]), (None, None), (None, prose(80)),
            (1006, prose(9000) + "\n" + passage + "\n" + prose(4000) + " " + passage + " " + prose(20)), (1007, "x" * 3000), (1008, "é" * 300 + " 漢字 " * 40), (1009, "a b c " * 200)]
    rows += [(1100 + k, texts[5]) for k in range(40)]
    for k in range(60):  # near copies of one text that are no near copies of each other
        w = hub.split()
        for at in rng.sample(range(300), 8):
            w[at] = f"edit{k}x{at}"
        rows.append((1200 + k, " ".join(w)))
    rows += [(1300, hub)]
    rows += [(1400 + k, prose(60) + " " + passage + " " + prose(60)) for k in range(20)]
    rows += [(1500, prose(200)), (1500, prose(200))]
    return [(i, t, None if i is None else "en", (None, "src0", "", "a source of its own")[k % 4], None, k, "yes") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def docs(spark):
    if not os.path.isdir(SF):
        pytest.skip("test tables absent")
    rows = [tuple(r.values()) + (0, "no") for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    return rows + odd_rows([r[1] for r in rows])


@pytest.fixture(scope="session")
def sf_dir(spark, docs, tmp_path_factory):
    """Tables of the smallest size with odd rows and columns among them."""
    top = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, DOCS).repartition(5).write.parquet(f"{top}/documents.parquet")
    pages = [tuple(r.values()) for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()]
    pages += [(9000 + k, "http://copies.example.org/en/1x?y", "<p>same\r\n\r\nWARC/1.1 body</p>") for k in range(30)]
    pages += [(9100, None, None), (9101, "no host", ""), (9102, "HTTP://WWW.Example.ORG", None), (9102, "HTTP://WWW.Example.ORG", None), (None, "x://a.com/fr/b", "<p>same\r\n\r\nWARC/1.1 body</p>"),
              (9103, "http://example.org/es/a#f", "é" * 5000), (9104, "http://badexample.org/es/", "a\nb"), (9105, "http://a.b.com/de/?q=/x", "z"),
              (9106, "ftp://free-bets.net/", "z"), (9107, "http://freebets.net/casinoroyale", ""), (9108, "http://x.net/a/CASINO/b", "k"), (9109, "http://a\r\nb.net/x", "k\x00")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumnRenamed("html", "html").repartition(3).write.parquet(f"{top}/pages.parquet")
    return top


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    """Empty tables."""
    top = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], DOCS).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{top}/pages.parquet")
    spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{top}/embeddings.parquet")
    return top
