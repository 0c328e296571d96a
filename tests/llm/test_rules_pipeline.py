import os

import corpus_pipeline
import duckdb
import pytest
from partloom.llm import common, mixing, queries, url_rules

from pyspark.sql import functions as F

from tests.llm.helpers import docs as given_docs
from tests.llm.helpers import rows
from tests.llm.test_dedup import slow_groups
from tests.llm.test_packing_mixing import check_pieces


def slow_judge(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fit, key=lambda x: len(x[0]), default=(None, default))
    return host, path, rule, verdict


URLS = [None, "", "no scheme/en/", "http://", "http://COM/", "https://a.example.com/en/1?x#y", "https://www.example.com/en/", "x://b.www.example.com/en/z", "http://notexample.com/en/", "http://example.net/es/1", "http://net/fr/",
        "http://example.net?x=/es/", "http://example.com#/en/", "ftp://example.com:80/en/", "http://q.com/a://b", "http://a..com/en/", "http://org.example/en/", "http://example.com/en"]


def test_rules_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(URLS)] * 2, "page_id long, url string, key string")
    rules = spark.createDataFrame(queries.RULES * 2 + [("", "/x", "block"), (None, "/y", "block")], "host string, path string, verdict string")
    want = sorted((i, *slow_judge(u, queries.RULES)) for i, u in enumerate(URLS) for _ in range(2))
    for spread in (1, 7):
        assert sorted(rows(url_rules.judge(pages, rules, spread=spread)), key=str) == sorted(want, key=str)
    assert {r.verdict for r in url_rules.judge(pages, rules.limit(0), default="block").collect()} == {"block"}
    assert url_rules.judge(pages.limit(0), rules).count() == 0


def test_deeply_nested_rules(spark):
    rules = [(".".join(["a"] * n), p, "block" if n % 2 else "allow") for n in range(1, 6) for p in ("/", "/x", "/x/y")]
    urls = [f"http://{'.'.join(['a'] * n)}{p}" for n in range(1, 8) for p in ("", "/", "/x", "/x/yz", "/y")] + ["http://ba.a/x", "http://a.b/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = rows(url_rules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")))
    for i, host, path, rule, verdict in got:
        h, p, want, says = slow_judge(urls[i], rules)
        assert (host, path, len(rule or "")) == (h, p, len(want or "")), urls[i]
        assert verdict == says or len([r for r in rules if len(r[0] + r[1]) == len(want or "")]) > 1


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op7_url_rules", "op10_mixing"])
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"create view {t.split('.')[0]} as select * from '{sf}/{t}'")
    got = queries.QUERIES[name](spark, sf)
    want = con.sql(queries.SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(str, rows(got.select(cols)))) == sorted(map(str, want.select(*[f'"{c}"' for c in cols]).fetchall()))


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mixing", "packing"]
    columns = docs.columns
    given = {r.doc_id: r for r in docs.collect()}
    recognised = corpus_pipeline.STAGES[0][1](spark, docs, sf).collect()
    assert {r.doc_id for r in recognised} == {d for d, r in given.items() if any(c.isalpha() for c in r.text)}
    after = spark.createDataFrame(recognised, docs.schema)
    exact = corpus_pipeline.STAGES[1][1](spark, after, sf).collect()
    last = {}
    for r in sorted(recognised, key=lambda r: r.doc_id):
        last[r.text] = r.doc_id
    assert sorted(r.doc_id for r in exact) == sorted(last.values())
    after = spark.createDataFrame(exact, docs.schema)
    near = corpus_pipeline.STAGES[2][1](spark, after, sf).collect()
    assert {r.doc_id for r in near} == set(slow_groups([(r.doc_id, r.text) for r in exact]).values())
    after = spark.createDataFrame(near, docs.schema)
    mixed = corpus_pipeline.STAGES[3][1](spark, after, sf)
    assert mixed.columns == columns
    taken = {r.doc_id: r.taken for r in mixing.taken(after).collect()}
    words = {}
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {d: t for d, t in taken.items() if t}
    pieces = corpus_pipeline.STAGES[4][1](spark, mixed, sf).collect()
    check_pieces(pieces, [(r.doc_id, r.text) for r in mixed.collect()])
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, pieces))


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, ties and repeats, and columns named as the operators' own."""
    texts = [None, "", " \n", "\u00bd \u2460", "the quick brown fox and so on", "the quick brown fox and so on", "word " * 30_000, "the quick brown fox and so on"]
    clashing = given_docs(spark, texts, ids=[1, 2, 3, 4, 5, 5, 6, None], sources=["a", None, "a", "b", "b", "b", None, "b"], langs=["en", "en", None, "en", "en", "en", "en", "en"])
    for c in ("head_id", "lang_pred", "luck", "rid", "head", "tie", "words", "runs", "id", "c0", "key", "part"):
        clashing = clashing.withColumn(c, F.lit(c))
    want = [[5, 5, 6, None], [5, 6], [5, 6], None]
    now = clashing
    for (name, stage), ids in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        assert stage(spark, now.limit(0), "").count() == 0, name
        now = stage(spark, now, "")
        assert now.columns == clashing.columns and now.where("head_id <> 'head_id' or score <> 'x'").count() == 0, name
        if ids:
            assert sorted((r.doc_id for r in now.collect()), key=str) == sorted(ids, key=str), name
    assert corpus_pipeline.STAGES[-1][1](spark, clashing, "").where("doc_tokens = 1").count() == 3
    assert corpus_pipeline.STAGES[-1][1](spark, clashing.limit(0), "").count() == 0


def test_tables_of_the_work_can_be_deleted(spark):
    path = common.cut(spark.range(3)).inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and common.clear(spark) > 0 and not os.path.exists(path)
