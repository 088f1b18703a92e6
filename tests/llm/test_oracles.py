"""The SQL of the exact operators against the queries, on the smallest tables; and edge cases of all operators."""

import duckdb
import pytest

from folioframe.llm import common, decontamination, jaccard_join, line_dedup, packing, pii, quality_rules, registry, secret_scan, substring_dedup, suffix_dedup, toxicity

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    got = registry.queries()[name](spark, FOLDER)
    told = db.execute(registry.oracle_sql()[name])
    names = [c[0] for c in told.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, told.fetchall()))


CLASHES = ["_d", "_h", "_t", "_row", "_text", "gone", "leaks", "_had", "sid", "k", "row", "spans", "kinds", "score", "unit", "hash", "_k", "_lang", "bin", "number"]


def odd(spark, rows, kind="string"):
    """Rows (id, text) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "en", *range(len(CLASHES))) for r in rows], f"doc_id {kind}, text string, lang string, " + ", ".join(f"{c} int" for c in CLASHES))


def outputs(docs, bench, model):
    """Numbers of rows of each operator's general interface; rows are what all but packing keep."""
    labels = docs.sparkSession.createDataFrame([], "doc_id string, toxic int")
    return {
        1: suffix_dedup.suffix_dedup(docs).collect(),
        2: toxicity.score_toxicity(docs, toxicity.fit(toxicity.labelled_rows(docs, labels))).collect(),
        3: substring_dedup.substring_dedup(docs).collect(),
        4: decontamination.find_leaks(docs, bench).collect(),
        5: quality_rules.quality_rules(docs).collect(),
        6: jaccard_join.jaccard_join(docs).collect(),
        7: packing.token_counts(docs).collect(),
        8: pii.replace_pii(docs).collect(),
        9: line_dedup.line_dedup(docs).collect(),
        10: secret_scan.find_secrets(docs, model).collect(),
    }


@pytest.fixture(scope="module")
def field(spark):
    return secret_scan.fit(spark.createDataFrame([("1", "some words")], "doc_id string, text string"))


def test_odd_tables(spark, field):
    """Text ids, null ids and texts, repeated rows, columns that clash, for all operators; all rows are there."""
    long = "all rights reserved by the publisher of this text " * 30
    rows = [("a", long), ("b", long), ("b", long), (None, None), (None, "x"), ("c", ""), ("d", None), ("e", "\n\n"), ("é", "tiny")]
    docs, bench = odd(spark, rows), spark.createDataFrame([("q", "reserved by the publisher")], "item_id string, text string")
    for n, got in outputs(docs, bench, field).items():
        assert len(got) == len(rows), n
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, _ in rows), n
    for left in (line_dedup.line_dedup(docs), decontamination.drop_leaks(docs, bench), jaccard_join.drop_near_duplicates(docs), toxicity.keep_clean(docs, 0.0)):
        assert left.columns == docs.columns
        assert all(r["gone"] == CLASHES.index("gone") and r["_h"] == CLASHES.index("_h") for r in left.collect())
    assert packing.pack_documents(docs).agg({"n_tokens": "sum"}).first()[0] == sum(r["n_tokens"] for r in packing.token_counts(docs).collect())


def test_empty_tables(spark, field):
    """No rows in, no rows out; an empty benchmark and empty labels change nothing."""
    none = odd(spark, [("a", "b")]).limit(0)
    bench = spark.createDataFrame([], "item_id string, text string")
    assert all(got == [] for got in outputs(none, bench, field).values())
    assert packing.pack_documents(none).count() == jaccard_join.drop_near_duplicates(none).count() == toxicity.keep_clean(none, 0.0).count() == 0


def test_very_long_texts(spark, field):
    """Texts of 2 MB, one line of a million characters among them: every operator takes them whole."""
    prose = " ".join(f"w{i * 7919 % 99991} of" for i in range(230_000))
    lines = "\n".join(f"line {i * 7919 % 99991} with enough characters to count" for i in range(40_000))
    docs = spark.createDataFrame([(1, prose, "en"), (2, prose + " end", "en"), (3, lines, "en"), (4, lines + "\nlast", "en"), (5, "x" * 1_000_000, "en")], "doc_id long, text string, lang string")
    bench = spark.createDataFrame([("q", prose[-300:])], "item_id string, text string")
    got = {n: {r["doc_id"]: r for r in x} for n, x in outputs(docs, bench, field).items()}
    assert all(len(x) == 5 for x in got.values())
    assert bytes(got[1][2]["kept"]) == b"end"
    assert got[3][2]["kept"] == "end" and got[6][2]["class_id"] == 1 and got[6][4]["class_id"] == 3
    assert len(got[4][1]["leaks"]) == len(got[4][2]["leaks"]) == 1 and not got[4][3]["leaks"]
    assert got[9][4]["text"] == "last" and got[9][5]["text"] == "x" * 1_000_000


def test_no_temporary_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"
        _jsc = spark.sparkContext._jsc

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})
        sparkContext = Context

    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        monkeypatch.setattr(Context, "_jsc", type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))}))
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)


def test_clear_intermediate(spark):
    kept = common.materialize(spark.range(3), "kept")
    path = kept.inputFiles()[0]
    assert kept.count() == 3
    common.clear_intermediate(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path).count()
