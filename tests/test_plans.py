import ast
import pathlib

from docsieve.operators import evaluation
from docsieve.plans import registry
from docsieve.session import cut, small
from docsieve.streaming import arrivals
from tests.conftest import ROOT, SMALL


def test_nothing_imports_the_training_data_package():
    for f in pathlib.Path(ROOT, "docsieve").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            names = [n.name if isinstance(n, ast.alias) else n.module or "" for node in ast.walk(ast.parse(f.read_text())) for n in ([*node.names] if isinstance(node, ast.Import) else [node] if isinstance(node, ast.ImportFrom) else [])]
            assert not any("llm" in n for n in names), f


def test_every_sql_has_a_query_and_the_flagship_runs(spark):
    assert set(registry.oracle_sql()) <= set(registry.queries())
    df = registry.flagship(spark, SMALL)
    assert df.columns == ["doc_id", "entity_count", "redacted_text"] and df.count() > 0


def test_checked_broadcast(spark):
    df = spark.range(100)
    assert "broadcast" in small(df)._jdf.queryExecution().toString().lower()
    assert "broadcast" not in small(df, "1000000")._jdf.queryExecution().toString().lower()
    assert cut(df).count() == 100


def test_f1(spark):
    schema = "k int, entity_type string, start_offset int, end_offset int"
    got = spark.createDataFrame([(1, "A", 0, 10), (1, "A", 2, 9), (2, "B", 0, 4)], schema)
    want = spark.createDataFrame([(1, "A", 0, 10), (2, "B", 50, 54)], schema)
    r = {x.entity_type: (x.tp, x.fp, x.fn) for x in evaluation.f1(got, want, "k").collect()}
    assert r == {"A": (1, 1, 0), "B": (0, 1, 1), None: (1, 2, 1)}


def test_stream_drops_rescans(spark, tmp_path):
    files = spark.read.parquet(f"{SMALL}/files.parquet").select("document_id", "sha256", "discovered_at", "source")
    files.coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = arrivals.first_seen(arrivals.arrivals(spark, str(tmp_path / "in"), files.schema), late="9000 days")
    q = rows.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == files.select("sha256").distinct().count()
