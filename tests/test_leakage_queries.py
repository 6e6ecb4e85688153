import duckdb
import pytest
from oracle import compare

from siftline.operators import leakage
from siftline.plans import bindings

NEAR = "near_duplicate_candidates pair_scores component_sizes component_members leakage_components largest_component direct_exclusion surviving_edges layered_manifests curated_layers".split()


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Documents whose numbers pass from nine digits to ten, with some copies."""
    d = tmp_path_factory.mktemp("long_ids")
    con = duckdb.connect()
    con.execute("create table documents as select (999999950 + i)::bigint as doc_id, 'text ' || (i % 90) as text, 'en' as lang, 's' as source, 7::bigint as n_chars from range(100) r(i)")
    con.execute(f"copy documents to '{d}/documents.parquet' (format parquet)")
    return str(d), con


@pytest.mark.parametrize("name", NEAR)
def test_numbers_of_ten_digits(spark, tables, name):
    d, con = tables
    assert compare(spark, name, bindings.QUERIES[name], bindings.ORACLE_SQL[name], d, con) == ""


def test_no_probes_in_the_plan(spark, tables):
    """Hashes meet in blocks: no row is multiplied by probes of its bands, whose masks stood in the plan."""
    for name in NEAR[:2]:
        plan = bindings.QUERIES[name](spark, tables[0])._jdf.queryExecution().optimizedPlan().toString()
        assert "explode(sequence" in plan.lower() or "mapinarrow" in plan.lower()
        assert len(plan) < 200_000 and "posexplode" not in plan.lower()


def test_surviving_edges_are_counted_in_one_pass(spark, tables):
    """What survives was joined and counted once for each two splits, and what leaves was worked out anew each time."""
    plan = bindings.QUERIES["surviving_edges"](spark, tables[0])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 6, plan.count("Relation [")


def test_layers_read_what_leaves_as_tables(spark, tables):
    for name, most in (("direct_exclusion", 6), ("layered_manifests", 6)):
        plan = bindings.QUERIES[name](spark, tables[0])._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") <= most, (name, plan.count("Relation ["))


def test_surviving_counts_are_those_of_the_list(spark):
    edges = spark.createDataFrame([("a", "b", "test", "train"), ("b", "c", "train", "val"), ("c", "b", "val", "train"), ("d", "e", "val", "test"), ("a", "x", "test", "train"), ("b", "f", "train", "train"), ("b", "g", "train", None)], "a string, b string, split_a string, split_b string")
    layer = spark.createDataFrame([(x,) for x in "abcdefg"], "key string")
    between = [("test", "train"), ("test", "val"), ("val", "train")]
    for kept in (layer, layer.where("key = 'z'")):
        got = leakage.surviving_counts(edges, kept, between).first().asDict()
        assert got == {"_".join(two): leakage.surviving(edges, kept, *two).count() for two in between}
    assert got == dict.fromkeys(["test_train", "test_val", "val_train"], 0)
