"""Queries against DuckDB on the smallest tables, and folding, writes and schemas on literal rows."""

import datetime as dt
import glob
import os
from enum import Enum

import duckdb
import pytest
from pyspark.sql import functions as F

from lattica import Catalog, Col, Embedded, EngineConfig, Id, MappingError, Other, Query, Shape, Through, ToMany, ToOne, Values, substring, where
from lattica.operators import raw
from lattica.operators.write import StaleObjectError, Store
from lattica.queries import ORACLES, QUERIES, Customer, CustomerOrders, Document, Order, OrderDetail, Region
from lattica.sources import schema
from lattica.streaming.iterate import each, flat_stream, iterate

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 4) + 0.0)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, dt.datetime) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    found = duck.execute(ORACLES[name])
    at = [[d[0] for d in found.description].index(c) for c in cols]
    assert len(found.description) == len(cols)
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


class State(Enum):
    NEW = 1
    DONE = 2


class Tag(Shape, table="tag"):
    id = Id(int)
    label = Col(str)


class Size(Shape):
    w = Col(int)
    h = Col(int)


class Item(Shape, table="item"):
    id = Id(int)
    title = Col(str)


class Box(Shape, table="box"):
    id = Id(int)
    state = Col(State)
    size = Embedded(Size)
    items = ToMany(Item, cascade=("insert", "update", "delete"))
    tags = Through(Tag, "box_tag")
    marks = Values(str, "box_mark", "mark")
    version = Col(int, version=True)


@pytest.fixture
def boxes(spark):
    c = Catalog(spark)
    c.add("box", spark.createDataFrame([(1, "NEW", 2, 3, 0), (2, "DONE", None, None, 0), (3, None, 1, None, 0)], "id long, state string, size_w long, size_h long, version long"))
    c.add("item", spark.createDataFrame([(10, "b", 1), (11, "a", 1), (12, "c", 2)], "id long, title string, box_id long"))
    c.add("tag", spark.createDataFrame([(5, "x"), (6, "y")], "id long, label string"))
    c.add("box_tag", spark.createDataFrame([(1, 5), (1, 6), (2, 5), (1, 5)], "box_id long, tag_id long"))
    c.add("box_mark", spark.createDataFrame([(1, "m"), (1, "k"), (3, None)], "box_id long, mark string"))
    return c


def test_entities(boxes):
    got = {r.id: r.asDict(recursive=True) for r in Query.of(Box, boxes).entities().collect()}
    assert got[1]["items"] == [{"id": 10, "title": "b"}, {"id": 11, "title": "a"}]
    assert got[1]["tags"] == [{"id": 5, "label": "x"}, {"id": 6, "label": "y"}]
    assert got[1]["marks"] == ["k", "m"] and got[1]["size"] == {"w": 2, "h": 3}
    assert got[2]["size"] is None and got[2]["marks"] == [] and got[2]["items"] == [{"id": 12, "title": "c"}]
    assert got[3]["items"] == [] and got[3]["marks"] == [] and got[3]["size"] == {"w": 1, "h": None}


def test_condition_on_children_removes_children_and_parents(boxes):
    q = Query.of(Box, boxes)
    got = {r.id: [i.id for i in r["items"]] for r in q.where(q.f.items.title.in_("a", "c")).entities().collect()}
    assert got == {1: [11], 2: [12]}
    assert q.where(q.f.items.title == "a").count() == 1


def test_flat_rows_multiply_branches(boxes):
    assert Query.of(Box, boxes).where("{box.id} = ?", 1).rows().count() == 2 * 3 * 2


def test_stream_equals_batch(boxes):
    q = Query.of(Box, boxes)
    q = q.order_by(q.f.state.desc())
    streamed = list(iterate(q))
    assert [r.id for r in streamed] == [1, 2, 3]
    assert sorted(streamed, key=lambda r: r.id) == sorted(q.entities().collect(), key=lambda r: r.id)
    assert next(q.stream(convert=True))["state"] is State.NEW
    assert each(q, lambda r: None) == 3


def test_stream_refuses_order_by_relation(boxes):
    q = Query.of(Box, boxes)
    with pytest.raises(MappingError):
        q.order_by(q.f.items.title).ordered_entities()
    with pytest.raises(MappingError):
        q.limit(1).entities()


def test_find_first_ids(boxes):
    q = Query.of(Box, boxes)
    assert q.find(2).state == "DONE" and q.find(9) is None and q.wheres == ()
    assert q.first().id == 1
    assert sorted(r[0] for r in q.where(q.f.state.is_null()).list_ids().collect()) == [3]
    with pytest.raises(MappingError):
        q.by_id({"nope": 1})


def test_other_map(spark):
    class Loose(Shape, table="loose"):
        id = Id(int)
        rest = Other()

    c = Catalog(spark).add("loose", spark.createDataFrame([(1, 2, "x")], "id long, a long, b string"))
    assert Query.of(Loose, c).entities().first().rest == {"a": "2", "b": "x"}


def test_gates(boxes):
    q = Query.of(Box, boxes)

    class Blob(Shape, table="blob"):
        id = Id(int)
        data = Col(bytes)

    with pytest.raises(TypeError):
        Query.of(Blob, boxes).f.data > b"x"  # noqa: B015
    with pytest.raises(ValueError):
        substring(q.f.state, 0, 1)
    with pytest.raises(AttributeError):
        q.f.nothing  # noqa: B018
    with pytest.raises(MappingError):
        q.join("cross", "tag", "t", "true")
    with pytest.raises(MappingError):
        q.join("left", "tag", "t", "")


def test_precedence(boxes):
    q = Query.of(Box, boxes)
    ids = lambda p: sorted(r[0] for r in q.where(p).list_ids().collect())
    f = q.f
    assert ids(where(f.id == 1).or_(f.id == 2).and_(f.state == "DONE")) == [1, 2]
    assert ids(where(where(f.id == 1).or_(f.id == 2)).and_(f.state == "DONE")) == [2]


def test_filters_reach_the_scan(spark):
    q = Query.of(Order, Catalog(spark, SF))
    plan = q.where(q.f.total > 100000.0).select("id", "customer.name").rows()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,100000.0)" in plan and "o_orderpriority" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_raw(spark):
    c = Catalog(spark, SF)
    c.table("region")
    assert raw.query_rows(c, "SELECT r_name FROM region WHERE r_regionkey = ? AND r_name <> '?'", 1)[0]["r_name"]
    cols = raw.query_columns(c, "SELECT r_regionkey, r_name FROM region ORDER BY 1")
    assert len(cols) == 2 and cols[0] == sorted(cols[0])
    assert raw.each_row(c, "SELECT * FROM region", lambda r: None) == len(cols[0])


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    s.create(Box, Item, Tag)
    assert s.insert(Box, {"state": State.NEW, "size": {"w": 1, "h": 2}, "version": 0}, {"state": State.DONE, "version": 0}) == [1, 2]
    box = Query.of(Box, s).find(1).asDict(recursive=True)
    assert box["size"] == {"w": 1, "h": 2} and box["state"] == "NEW"
    box["state"] = State.DONE
    assert s.update(Box, box) == 1 and box["version"] == 1
    with pytest.raises(StaleObjectError):
        s.update(Box, {**box, "version": 0})
    box["items"] = [{"title": "a"}, {"title": "b"}]
    s.save_children(Box, "items", box)
    stored = Query.of(Box, s).find(1)
    assert [i.title for i in stored["items"]] == ["a", "b"]
    box["items"] = [{"id": stored["items"][1].id, "title": "B"}, {"id": 0, "title": "c"}]
    s.save_children(Box, "items", box)
    assert sorted(i.title for i in Query.of(Box, s).find(1)["items"]) == ["B", "c"]
    box["marks"] = ["k", "m"]
    s.save_children(Box, "marks", box)
    s.upsert(Tag, {"id": 5, "label": "x"}, {"id": 6, "label": "y"})
    s.upsert(Tag, {"id": 6, "label": "z"})
    box["tags"] = [{"id": 5}, {"id": 6}]
    s.save_children(Box, "tags", box)
    got = Query.of(Box, s).find(1)
    assert got.marks == ["k", "m"] and [t.label for t in got.tags] == ["x", "z"]
    s.delete(Box, 2)
    assert Query.of(Box, s).count() == 1


def test_transaction_is_all_or_nothing(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    s.create(Tag)
    with pytest.raises(ZeroDivisionError), s.transaction():
        s.insert(Tag, {"id": 1, "label": "x"})
        assert Query.of(Tag, s).count() == 1
        1 / 0  # noqa: B018
    assert Query.of(Tag, s).count() == 0


def test_schemas():
    cols = schema.table_schemas(Box)
    assert list(cols) == ["box", "box_tag", "box_mark"]
    assert [f.name for f in cols["box"]] == ["id", "state", "size_w", "size_h", "version"] and not cols["box"]["id"].nullable
    assert schema.primary_keys(Box)["box_tag"] == ["box_id", "tag_id"]
    assert schema.ForeignKey("box_tag", "tag_id", "tag", "id") in schema.foreign_keys(Box)
    assert "item" in schema.table_schemas(Box, Item) and "box_id" in schema.table_schemas(Box, Item)["item"].names
    assert schema.create_statements(Tag) == ["CREATE TABLE `tag` (`id` BIGINT NOT NULL, `label` STRING) USING parquet TBLPROPERTIES ('primary_key' = 'id')"]


def test_migration(spark):
    c = Catalog(spark).add("tag", spark.createDataFrame([(1,)], "id long"))
    assert schema.migration_statements(c, Tag) == ["ALTER TABLE `tag` ADD COLUMNS (`label` STRING)"]
    schema.execute_ddl(c, [x.replace("`tag`", "`made_tag`") for x in schema.create_statements(Tag)])
    assert spark.table("made_tag").columns == ["id", "label"]
    spark.sql("DROP TABLE made_tag")
    assert schema.nulls(Catalog(spark, SF), Region).first()[0] == 0


def test_structured_stream(spark, tmp_path):
    source = spark.readStream.schema(spark.read.parquet(f"{SF}/customer.parquet").schema).parquet(f"{SF}/customer.parquet*")
    c = Catalog(spark, SF).add("customer", source)
    q = Query.of(Customer, c)
    out = flat_stream(q.where(q.f.nation.region.name == "ASIA")).toDF(*[x.replace(".", "_") for x in q.rows().columns])
    run = out.writeStream.format("memory").queryName("asia").option("checkpointLocation", str(tmp_path)).start()
    run.processAllAvailable()
    run.stop()
    b = Query.of(Customer, Catalog(spark, SF))
    assert spark.table("asia").count() == b.where(b.f.nation.region.name == "ASIA").rows().count()
    with pytest.raises(MappingError):
        flat_stream(Query.of(CustomerOrders, c))


def test_document_types(spark):
    e = Query.of(Document, Catalog(spark, SF)).entities()
    assert {r[0] for r in e.select("_type").distinct().collect()} == {"Document", "LabeledDocument"}
    assert e.filter(F.col("_type") == "Document").filter("quality is not null").count() == 0


def test_two_level_arrays(spark):
    e = Query.of(OrderDetail, Catalog(spark, SF)).entities()
    assert e.filter(F.size("lines") == 0).count() == e.count() - spark.read.parquet(f"{SF}/lineitem.parquet").join(e.select("id"), F.col("l_orderkey") == F.col("id"), "left_semi").select("l_orderkey").distinct().count()


def scans_and_exchanges(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    executed = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Relation ["), executed.count("Exchange hashpartitioning")


def test_unused_to_one_joins_go(spark):
    """A to-one join that nothing refers to isn't read; the rows stay the same."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert scans_and_exchanges(QUERIES["topk_join"](spark, SF))[0] == 2
        assert scans_and_exchanges(QUERIES["join_to_one"](spark, SF))[0] == 2
        # A branch without conditions is read without its parent: one exchange for it and one for the parent's rows.
        assert scans_and_exchanges(QUERIES["fold_to_many_sizes"](spark, SF)) == (2, 2)
        assert scans_and_exchanges(QUERIES["fold_nested_two_level"](spark, SF))[0] == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_raw_text_keeps_its_joins(spark):
    c = Catalog(spark, SF)
    q = Query.of(Order, c).select("id")
    n = Query.of(Order, c).count()
    assert q.where("c_acctbal IS NOT NULL").rows().count() == n
    assert q.where("customer.c_acctbal IS NOT NULL").rows().count() == n
    assert q.order_by("{customer.nation.name} DESC", "o_orderkey").rows().first()[0] is not None


def test_two_changes_with_one_key_raise(spark):
    from lattica.operators import write

    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    with pytest.raises(Exception, match="two changes have one id"):
        write.updated(table, spark.createDataFrame([(1, "c"), (1, "d")], "id long, x string"), ["id"]).collect()


def test_numbered_over_many_ranges(spark):
    from lattica.operators import write

    table = spark.createDataFrame([(7, "a")], "id long, x string")
    rows = spark.createDataFrame([(f"r{i:03d}",) for i in range(200)], "x string").repartition(7)
    out = {r.x: r.id for r in write.numbered(table, rows, "id", ["x"]).collect()}
    assert out == {f"r{i:03d}": 8 + i for i in range(200)}


def test_changes_between_sessions_are_seen(spark, tmp_path):
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    one.create(Tag)
    with pytest.raises(StaleObjectError), one.transaction():
        one.insert(Tag, {"id": 1, "label": "x"})
        two.insert(Tag, {"id": 2, "label": "y"})
    assert [r.id for r in two.table("tag").collect()] == [2]


def test_rows_from_elsewhere_need_all_columns(spark, boxes):
    with pytest.raises(MappingError):
        Query.of(Box, boxes).fold_rows(spark.createDataFrame([(1,)], "`box.id` long"))


def test_jdbc(spark):
    """Tables of a database (one in this JVM's memory), read in parallel parts, filters sent to it."""
    url, driver = "jdbc:derby:memory:lattica;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    for name in ("customer", "nation", "region"):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        types = ", ".join(f"{f.name} VARCHAR(200)" for f in df.schema if f.dataType.simpleString() == "string")
        df.write.format("jdbc").mode("overwrite").options(url=url, dbtable=name, driver=driver, createTableColumnTypes=types).save()
    c = Catalog(spark).add_jdbc("region", url, "region", driver=driver).add_jdbc("nation", url, "nation", driver=driver)
    c.add_jdbc("customer", url, "customer", driver=driver, partitionColumn="c_custkey", lowerBound="1", upperBound="150", numPartitions="3")
    assert c.table("customer").rdd.getNumPartitions() == 3

    def asia(c):
        q = Query.of(Customer, c)
        return q.where(q.f.nation.region.name == "ASIA", q.f.balance > 0).rows()

    assert sorted(map(str, asia(c).collect())) == sorted(map(str, asia(Catalog(spark, SF)).collect()))
    assert "*EqualTo(r_name,ASIA)" in asia(c)._jdf.queryExecution().toString()


def test_engine_config(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    config = EngineConfig().set("spark.sql.ansi.enabled", False).sized(input_bytes=100 << 40, cores=4000)
    c = Catalog(spark, SF, config=config)
    assert c.spark.conf.get("spark.sql.shuffle.partitions") == str((100 << 40) // (128 << 20)) and c.spark.conf.get("spark.sql.ansi.enabled") == "false"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and c.spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert EngineConfig().sized(1, 8).settings["spark.sql.shuffle.partitions"] == "16" and EngineConfig().settings == {}
    assert Query.of(Region, c).rows().count() == 5
    with pytest.raises(ValueError):
        EngineConfig().set("spark.sql.warehouse.dir", "/elsewhere").session(spark)


def test_links_to_composite_ids_need_a_condition(spark):
    class Two(Shape, table="two"):
        a = Id(int)
        b = Id(int)

    class Many(Shape, table="many"):
        id = Id(int)
        twos = Through(Two, table="many_two")

    with pytest.raises(MappingError):
        Query.of(Many, Catalog(spark, SF)).rows()
