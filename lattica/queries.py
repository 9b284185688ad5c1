"""Queries over the test tables: one for each operator, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from uuid import UUID

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica import Catalog, Col, Embedded, EngineConfig, ExtraJoin, Id, MappingError, Other, Query, Select, Shape, Through, ToMany, ToOne, Values, coalesce, concat, length, lower, substring, upper, where
from lattica.operators import raw, write
from lattica.sources import schema
from lattica.streaming.iterate import each, iterate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Region(Shape, table="region"):
    id = Id(int, "r_regionkey")
    name = Col(str, "r_name")


class Nation(Shape, table="nation"):
    id = Id(int, "n_nationkey")
    name = Col(str, "n_name")
    region = ToOne(Region, "n_regionkey")


class Customer(Shape, table="customer"):
    id = Id(int, "c_custkey")
    name = Col(str, "c_name")
    balance = Col(float, "c_acctbal")
    segment = Col(str, "c_mktsegment")
    nation = ToOne(Nation, "c_nationkey")


class FlatCustomer(Shape, table="customer"):
    id = Id(int, "c_custkey")
    name = Col(str, "c_name")
    balance = Col(float, "c_acctbal")
    segment = Col(str, "c_mktsegment")
    nation_key = Col(int, "c_nationkey")


class Supplier(Shape, table="supplier"):
    id = Id(int, "s_suppkey")
    name = Col(str, "s_name")
    balance = Col(float, "s_acctbal")
    nation = ToOne(Nation, "s_nationkey")


class Part(Shape, table="part"):
    id = Id(int, "p_partkey")
    name = Col(str, "p_name")
    brand = Col(str, "p_brand")
    size = Col(int, "p_size")
    price = Col(float, "p_retailprice")


class Order(Shape, table="orders"):
    id = Id(int, "o_orderkey")
    status = Col(str, "o_orderstatus")
    total = Col(float, "o_totalprice")
    date = Col(datetime, "o_orderdate")
    priority = Col(str, "o_orderpriority")
    customer = ToOne(Customer, "o_custkey")


class PlainOrder(Shape, table="orders"):
    id = Id(int, "o_orderkey")
    status = Col(str, "o_orderstatus")
    total = Col(float, "o_totalprice")
    customer_key = Col(int, "o_custkey")


class OrderLine(Shape, table="lineitem"):
    order_key = Col(int, "l_orderkey")
    number = Col(int, "l_linenumber")
    quantity = Col(float, "l_quantity")
    price = Col(float, "l_extendedprice")
    part_key = Col(int, "l_partkey")
    flag = Col(str, "l_returnflag")


class LineWithPart(Shape, table="lineitem"):
    order_key = Col(int, "l_orderkey")
    number = Col(int, "l_linenumber")
    quantity = Col(float, "l_quantity")
    price = Col(float, "l_extendedprice")
    part = ToOne(Part, "l_partkey")
    supplier = ToOne(Supplier, "l_suppkey")


class OrderDetail(Shape, table="orders"):
    id = Id(int, "o_orderkey")
    status = Col(str, "o_orderstatus")
    total = Col(float, "o_totalprice")
    lines = ToMany(OrderLine, "l_orderkey")


class OrderParts(Shape, table="orders"):
    id = Id(int, "o_orderkey")
    parts = Through(Part, "lineitem", "l_orderkey", "l_partkey")


class CustomerEvents(Shape, table="customer"):
    id = Id(int, "c_custkey")
    name = Col(str, "c_name")
    types = Values(str, "events", "event_type", "user_id", distinct=True)


class CustomerErrors(Shape, table="customer"):
    id = Id(int, "c_custkey")
    types = Values(str, "events", "event_type", "user_id", on="{linktable}.event_type = 'error' AND {linktable}.value > 50")


class CustomerOrders(Shape, table="customer"):
    id = Id(int, "c_custkey")
    name = Col(str, "c_name")
    orders = ToMany(PlainOrder, "o_custkey")


class CustomerBigOrders(Shape, table="customer"):
    id = Id(int, "c_custkey")
    name = Col(str, "c_name")
    orders = ToMany(PlainOrder, on="{this}.c_custkey = {field}.o_custkey AND {field}.o_totalprice > 40 * {this}.c_acctbal")


class PlainEvent(Shape, table="events"):
    id = Id(int, "event_id")
    type = Col(str, "event_type")
    value = Col(float)


class CustomerActivity(Shape, table="customer"):
    id = Id(int, "c_custkey")
    orders = ToMany(PlainOrder, "o_custkey")
    events = ToMany(PlainEvent, "user_id")


class CustomerTree(Shape, table="customer"):
    id = Id(int, "c_custkey")
    orders = ToMany(OrderDetail, "o_custkey")


class RegionTree(Shape, table="region"):
    id = Id(int, "r_regionkey")
    name = Col(str, "r_name")
    nations = ToMany("FlatNation", "n_regionkey")


class FlatNation(Shape, table="nation"):
    id = Id(int, "n_nationkey")
    name = Col(str, "n_name")


class Money(Shape):
    price = Col(float, "extendedprice")
    discount = Col(float)


class LineMoney(Shape, table="lineitem"):
    order_key = Col(int, "l_orderkey")
    number = Col(int, "l_linenumber")
    money = Embedded(Money, "l_")


class CustomerRef(Shape):
    customer = ToOne(FlatCustomer, "custkey")


class OrderEmbedded(Shape, table="orders"):
    id = Id(int, "o_orderkey")
    ref = Embedded(CustomerRef, "o_")


class OtherPart(Shape, table="part"):
    id = Id(int, "p_partkey")
    name = Col(str, "p_name")
    other = Other("p_")


class ComputedCustomer(Shape, table="customer"):
    id = Id(int, "c_custkey")
    label = Select("concat({this}.c_name, '/', {this}.c_mktsegment)")
    upper_label = Select("upper({customer.label})")


class Event(Shape, table="events", discriminator="event_type", variants=lambda: [Purchase, Click]):
    id = Id(int, "event_id")
    user_key = Col(int, "user_id")
    value = Col(float)


class Purchase(Event, tag="purchase"):
    props = Col(str)


class Click(Event, tag="click"):
    ts = Col(datetime)


class Document(Shape, table="documents", variants=lambda: [LabeledDocument]):
    doc_id = Id(int)
    lang = Col(str)
    source = Col(str)


class LabeledDocument(Document, table="labels"):
    quality = Col(int)
    toxic = Col(int)


class Turn(Shape, table="conversations"):
    conv_id = Id(int)
    turn = Id(int)
    role = Col(str)


class NationStats(Shape, table="nation", joins=[ExtraJoin("left", "customer", "customer", "{customer}.c_nationkey = {this}.n_nationkey"), ExtraJoin("left", "supplier", "supplier", "{supplier}.s_nationkey = {this}.n_nationkey")], group_by=["{nation.name}"]):
    name = Col(str, "n_name")
    customers = Select("COUNT({customer}.c_custkey)")
    suppliers = Select("COUNT({supplier}.s_suppkey)")


class SegmentStats(Shape, table="customer", group_by=["customer.c_mktsegment"], order_by=["{customer.n} DESC", "{customer.segment}"]):
    segment = Col(str, "c_mktsegment")
    n = Select("COUNT(*)")
    total = Select("ROUND(SUM({this}.c_acctbal), 2)")
    largest = Select("MAX({this}.c_acctbal)")


class Person(Shape, table="person"):
    id = Id(int)
    name = Col(str)


class Team(Shape, table="team"):
    id = Id(int)
    captain = ToOne(Person, "captain_id")
    members = Through(Person, "team_member")
    colors = Values(str, "team_color", "color")


class OrderedRegion(Shape, table="region", order_by=["{region.name} DESC"]):
    id = Id(int, "r_regionkey")
    name = Col(str, "r_name")


def snake(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.replace(".", "_") for c in df.columns))


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[Catalog], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: snake(f(Catalog(spark, sf_dir)))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def flat(name: str, shape: type[Shape], make: Callable[[Query], Query], sql: str) -> None:
    """A query of selected flat rows."""
    QUERIES[name] = lambda spark, sf_dir: snake(make(Query.of(shape, Catalog(spark, sf_dir))).rows())
    ORACLES[name] = sql


# Scans and projections.
flat("scan_plain", Region, lambda q: q, "SELECT r_regionkey AS region_id, r_name AS region_name FROM region")
flat("scan_all_columns", FlatCustomer, lambda q: q, "SELECT c_custkey AS customer_id, c_name AS customer_name, c_acctbal AS customer_balance, c_mktsegment AS customer_segment, c_nationkey AS customer_nation_key FROM customer")
flat("proj_renamed", Part, lambda q: q.select("id", "brand"), "SELECT p_partkey AS part_id, p_brand AS part_brand FROM part")
flat("proj_select_expr", ComputedCustomer, lambda q: q, "SELECT c_custkey AS customer_id, c_name || '/' || c_mktsegment AS customer_label, upper(c_name || '/' || c_mktsegment) AS customer_upper_label FROM customer")
flat("proj_add_field", Part, lambda q: q.select("id").add_field("{part.size} * 2 + 1", "twice"), "SELECT p_partkey AS part_id, p_size * 2 + 1 AS twice FROM part")
flat("proj_set_fields", Order, lambda q: q.set_fields(k="{orders.id}", who="{customer.name}"), "SELECT o_orderkey AS k, c_name AS who FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
flat("proj_embedded", LineMoney, lambda q: q, "SELECT l_orderkey AS lineitem_order_key, l_linenumber AS lineitem_number, l_extendedprice AS money_price, l_discount AS money_discount FROM lineitem")
flat("proj_scalar_subquery", Region, lambda q: q.select("name").add_field("(SELECT count(*) FROM VALUES (1), (2) AS t(x))", "two"), "SELECT r_name AS region_name, 2 AS two FROM region")


@query("SELECT p_partkey AS id, array_to_string(list_sort(['brand=' || p_brand, 'type=' || p_type, 'size=' || p_size]), ',') AS pairs, array_to_string(['brand', 'retailprice', 'size', 'type'], ',') AS names, p_retailprice AS price FROM part")
def proj_other_map_keys(c: Catalog) -> DataFrame:
    """All pairs of the map: the price as a number, as its text differs between engines."""
    e = Query.of(OtherPart, c).entities()
    pairs = F.map_filter("other", lambda k, _: k != "retailprice")
    text = F.array_sort(F.transform(F.map_entries(pairs), lambda x: F.concat(x["key"], F.lit("="), x["value"])))
    return e.select("id", F.array_join(text, ",").alias("pairs"), F.array_join(F.array_sort(F.map_keys("other")), ",").alias("names"), F.col("other")["retailprice"].cast("double").alias("price"))


@query("SELECT DISTINCT o_custkey AS customer_id FROM orders WHERE o_totalprice > 300000")
def list_ids_distinct(c: Catalog) -> DataFrame:
    return Query.of(CustomerOrders, c).where("{orders.total} > ?", 300000).list_ids()


# Filters.
NATION_JOIN = "nation LEFT JOIN region ON n_regionkey = r_regionkey"
CUSTOMER_JOIN = f"customer LEFT JOIN ({NATION_JOIN}) ON c_nationkey = n_nationkey"
ORDER_JOIN = f"orders LEFT JOIN ({CUSTOMER_JOIN}) ON o_custkey = c_custkey"


def test_of(name: str, shape: type[Shape], make: Callable[[Query], Query], key: str, tables: str, condition: str) -> None:
    """A query whose condition is what matters: the ids that are left."""
    root = shape.table()
    flat(name, shape, lambda q: make(q).select("id"), f"SELECT {key} AS {root}_id FROM {tables} WHERE {condition}")


test_of("where_raw_params", FlatCustomer, lambda q: q.where("{customer.balance} > ? AND {customer.segment} <> ?", 5000.0, "it's ?"), "c_custkey", "customer", "c_acctbal > 5000")
test_of("where_marker_join_alias", Order, lambda q: q.where("{customer.nation.region}.r_name = ?", "ASIA"), "o_orderkey", ORDER_JOIN, "r_name = 'ASIA'")
test_of("where_this_marker", FlatCustomer, lambda q: q.where("{this}.c_acctbal < ? OR {this.segment} = ?", 0, "BUILDING"), "c_custkey", "customer", "c_acctbal < 0 OR c_mktsegment = 'BUILDING'")
test_of("where_computed_field", ComputedCustomer, lambda q: q.where("{customer.upper_label} LIKE ?", "%BUILDING"), "c_custkey", "customer", "upper(c_name || '/' || c_mktsegment) LIKE '%BUILDING'")
test_of("multi_where", FlatCustomer, lambda q: q.where("{customer.segment} = 'BUILDING' OR {customer.segment} = 'MACHINERY'").where("{customer.balance} > 0"), "c_custkey", "customer", "(c_mktsegment = 'BUILDING' OR c_mktsegment = 'MACHINERY') AND c_acctbal > 0")
test_of("op_eq", Order, lambda q: q.where(q.f.status == "F"), "o_orderkey", "orders", "o_orderstatus = 'F'")
flat("op_eq_field", LineWithPart, lambda q: q.where(q.f.part.id == q.f.supplier.id).set_fields(lineitem_id="{lineitem.order_key}"), "SELECT l_orderkey AS lineitem_id FROM lineitem WHERE l_partkey = l_suppkey")
test_of("op_ne", Order, lambda q: q.where(q.f.status != "F"), "o_orderkey", "orders", "o_orderstatus <> 'F'")
test_of("op_gt", Part, lambda q: q.where(q.f.size > 25), "p_partkey", "part", "p_size > 25")
test_of("op_lt", Part, lambda q: q.where(q.f.size < 25), "p_partkey", "part", "p_size < 25")
test_of("op_ge", Part, lambda q: q.where(q.f.size >= 25), "p_partkey", "part", "p_size >= 25")
test_of("op_le", Part, lambda q: q.where(q.f.size <= 25), "p_partkey", "part", "p_size <= 25")
test_of("op_gt_field", Order, lambda q: q.where(q.f.customer.balance > q.f.total), "o_orderkey", ORDER_JOIN, "c_acctbal > o_totalprice")
test_of("op_date_ge", Order, lambda q: q.where(q.f.date >= datetime(1996, 1, 1)), "o_orderkey", "orders", "o_orderdate >= TIMESTAMP '1996-01-01'")
test_of("op_in", Order, lambda q: q.where(q.f.status.in_("F", "P")), "o_orderkey", "orders", "o_orderstatus IN ('F', 'P')")
test_of("op_in_none", Order, lambda q: q.where(q.f.status.in_()), "o_orderkey", "orders", "false")
test_of("op_like", Part, lambda q: q.where(q.f.brand.like("%#1%")), "p_partkey", "part", "p_brand LIKE '%#1%'")
test_of("op_not_like", Part, lambda q: q.where(q.f.brand.not_like("%#1%")), "p_partkey", "part", "p_brand NOT LIKE '%#1%'")
test_of("op_between", Part, lambda q: q.where(q.f.size.between(10, 20)), "p_partkey", "part", "p_size BETWEEN 10 AND 20")
flat("op_is_null", Document, lambda q: q.where(q.f.labels.quality.is_null()).select("doc_id"), "SELECT doc_id AS documents_doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
flat("op_is_not_null", Document, lambda q: q.where(q.f.labels.quality.is_not_null()).select("doc_id"), "SELECT doc_id AS documents_doc_id FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
test_of("rel_is_null", OrderDetail, lambda q: q.where("{lines.order_key} IS NULL"), "o_orderkey", "orders LEFT JOIN lineitem ON o_orderkey = l_orderkey", "l_orderkey IS NULL")
test_of("rel_is_not_null", Order, lambda q: q.where(q.f.customer.nation.is_not_null()), "o_orderkey", ORDER_JOIN, "n_nationkey IS NOT NULL")
test_of("chain_and", Part, lambda q: q.where(where(q.f.size > 10).and_(q.f.price < 1500).and_(q.f.brand != "Brand#11")), "p_partkey", "part", "p_size > 10 AND p_retailprice < 1500 AND p_brand <> 'Brand#11'")
test_of("chain_or_precedence", Part, lambda q: q.where(where(q.f.size == 1).or_(q.f.size == 2).and_(q.f.price > 1200)), "p_partkey", "part", "p_size = 1 OR p_size = 2 AND p_retailprice > 1200")
test_of("group_and_sub", Part, lambda q: q.where(where(q.f.price > 950).and_(where(q.f.size == 1).or_(q.f.size == 2))), "p_partkey", "part", "p_retailprice > 950 AND (p_size = 1 OR p_size = 2)")
test_of("group_or_sub", Part, lambda q: q.where(where(q.f.size == 1).or_(where(q.f.size > 40).and_(q.f.price > 1200))), "p_partkey", "part", "p_size = 1 OR (p_size > 40 AND p_retailprice > 1200)")
test_of("where_sub", Part, lambda q: q.where((q.f.size == 1) | (q.f.size == 3)).where(q.f.price > 920), "p_partkey", "part", "(p_size = 1 OR p_size = 3) AND p_retailprice > 920")
test_of("expr_in", Part, lambda q: q.where(lower(q.f.brand).in_("brand#11", "brand#22")), "p_partkey", "part", "lower(p_brand) IN ('brand#11', 'brand#22')")
test_of("expr_not_in", Part, lambda q: q.where(lower(q.f.brand).not_in("brand#11", "brand#22")), "p_partkey", "part", "lower(p_brand) NOT IN ('brand#11', 'brand#22')")
test_of("expr_vs_field", Customer, lambda q: q.where(upper(q.f.segment) == q.f.segment), "c_custkey", "customer", "upper(c_mktsegment) = c_mktsegment")
test_of("expr_vs_expr", Customer, lambda q: q.where(length(q.f.name) != length(q.f.segment)), "c_custkey", "customer", "length(c_name) <> length(c_mktsegment)")
test_of("expr_like", Customer, lambda q: q.where(concat(q.f.segment, "-", q.f.nation.name).like("BUILDING-%_2")), "c_custkey", CUSTOMER_JOIN, "(c_mktsegment || '-' || n_name) LIKE 'BUILDING-%_2'")
test_of("expr_not_like", Customer, lambda q: q.where(lower(q.f.segment).not_like("%u%")), "c_custkey", "customer", "lower(c_mktsegment) NOT LIKE '%u%'")
flat("expr_is_null", Document, lambda q: q.where(lower(q.f.lang).is_not_null() & q.f.labels.toxic.coalesce(0).eq(1)).select("doc_id"), "SELECT doc_id AS documents_doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 1")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey = 42")
def find_by_id(c: Catalog) -> DataFrame:
    return Query.of(FlatCustomer, c).by_id(42).entities().select("id", "name")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 AND turn = 1")
def find_by_composite_id(c: Catalog) -> DataFrame:
    return Query.of(Turn, c).by_id({"conv_id": 3, "turn": 1}).entities()


# Functions.
def function(name: str, shape: type[Shape], make: Callable, sql: str, tables: str, key: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = Query.of(shape, Catalog(spark, sf_dir))
        return q.source().select(q.column(q.f.__getattr__("doc_id" if shape is Document else "id")).alias("id"), q.column(make(q.f)).alias("x"))

    QUERIES[name] = run
    ORACLES[name] = f"SELECT {key} AS id, {sql} AS x FROM {tables}"


function("fn_concat", Customer, lambda f: concat(f.name, " in ", f.nation.name), "c_name || ' in ' || n_name", CUSTOMER_JOIN, "c_custkey")
function("fn_concat_null", Document, lambda f: concat(f.lang, f.labels.quality), "lang || quality::VARCHAR", "documents LEFT JOIN labels USING (doc_id)", "doc_id")
function("fn_lower", Customer, lambda f: lower(f.segment), "lower(c_mktsegment)", "customer", "c_custkey")
function("fn_upper", Part, lambda f: upper(f.name), "upper(p_name)", "part", "p_partkey")
function("fn_trim", Part, lambda f: concat("  ", f.name, " ").trim(), "trim('  ' || p_name || ' ')", "part", "p_partkey")
function("fn_length", Part, lambda f: length(f.name), "length(p_name)", "part", "p_partkey")
function("fn_coalesce", Document, lambda f: coalesce(f.labels.quality, -1), "coalesce(quality, -1)", "documents LEFT JOIN labels USING (doc_id)", "doc_id")
function("fn_abs", Customer, lambda f: f.balance.abs(), "abs(c_acctbal)", "customer", "c_custkey")
function("fn_substring", Part, lambda f: substring(f.name, 2, 3), "substring(p_name, 2, 3)", "part", "p_partkey")
function("fn_nested", Customer, lambda f: upper(substring(concat(f.segment, "#", f.nation.name), 3, 9)).trim(), "trim(upper(substring(c_mktsegment || '#' || n_name, 3, 9)))", CUSTOMER_JOIN, "c_custkey")

# Joins.
flat("join_to_one", Customer, lambda q: q.select("id", "nation.name"), f"SELECT c_custkey AS customer_id, n_name AS nation_name FROM {CUSTOMER_JOIN}")
flat("join_to_many", OrderDetail, lambda q: q.where("{orders.status} = 'P'").select("id", "lines.number", "lines.quantity"), "SELECT o_orderkey AS orders_id, l_linenumber AS lines_number, l_quantity AS lines_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'")
flat("join_many_to_many", OrderParts, lambda q: q.where("{parts.size} > 45").select("id", "parts.id", "parts.name"), "SELECT o_orderkey AS orders_id, p_partkey AS parts_id, p_name AS parts_name FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size > 45")
flat("join_values", CustomerEvents, lambda q: q.select("id", "types.value"), "SELECT c_custkey AS customer_id, event_type AS types_value FROM customer LEFT JOIN events ON user_id = c_custkey")
flat("join_condition_theta", CustomerBigOrders, lambda q: q.select("id", "orders.id"), "SELECT c_custkey AS customer_id, o_orderkey AS orders_id FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 40 * c_acctbal")
flat("join_condition_literal_on_link", CustomerErrors, lambda q: q, "SELECT c_custkey AS customer_id, event_type AS types_value FROM customer LEFT JOIN events ON user_id = c_custkey AND event_type = 'error' AND value > 50")
for _how in ("left", "inner", "right"):
    flat(f"join_explicit_{_how}", FlatNation, lambda q, how=_how: q.join(how, "supplier", "sup", "{sup}.s_nationkey = {nation.id} AND {sup}.s_acctbal > 5000").set_fields(nation="{nation.name}", supplier="{sup}.s_name"), f"SELECT n_name AS nation, s_name AS supplier FROM nation {_how} JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000")
flat("join_same_table_twice", LineWithPart, lambda q: q.join("left", "nation", "home", "{home}.n_nationkey = {supplier}.s_nationkey").join("left", "nation", "next", "{next}.n_nationkey = {home}.n_nationkey + 1").set_fields(order_key="{lineitem.order_key}", home="{home}.n_name", neighbour="{next}.n_name"), "SELECT l_orderkey AS order_key, a.n_name AS home, b.n_name AS neighbour FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation a ON a.n_nationkey = s_nationkey LEFT JOIN nation b ON b.n_nationkey = a.n_nationkey + 1")
flat("inherit_super_inner", LabeledDocument, lambda q: q, "SELECT quality AS labels_quality, toxic AS labels_toxic, doc_id AS labels_doc_id, lang AS labels_lang, source AS labels_source FROM labels JOIN documents USING (doc_id)")
flat("inherit_subclasses_left", Document, lambda q: q, "SELECT d.doc_id AS documents_doc_id, lang AS documents_lang, source AS documents_source, l.doc_id AS documents_labels_doc_id, quality AS documents_labels_quality, toxic AS documents_labels_toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
flat("embedded_link", OrderEmbedded, lambda q: q.select("id", "ref.customer.name"), "SELECT o_orderkey AS orders_id, c_name AS ref_customer_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")


@query(f"SELECT n_name AS nation, r_name AS region, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM {ORDER_JOIN} WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY ALL")
def join_to_one_chain4(c: Catalog) -> DataFrame:
    q = Query.of(Order, c)
    q = q.where(q.f.customer.nation.region.name.in_("ASIA", "EUROPE")).group_by(q.f.customer.nation.name, q.f.customer.nation.region.name)
    return q.set_fields(nation="{customer.nation.name}", region="{customer.nation.region.name}", n="COUNT(*)", total="ROUND(SUM({orders.total}), 2)").rows()


@query("SELECT c_custkey AS id, count(o_orderkey)::BIGINT AS n_orders, count(event_id)::BIGINT AS n_events FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN events ON c_custkey = user_id GROUP BY 1")
def join_two_to_many_product(c: Catalog) -> DataFrame:
    return Query.of(CustomerActivity, c).group_by("{customer.id}").set_fields(id="{customer.id}", n_orders="COUNT({orders.id})", n_events="COUNT({events.id})").rows()


# Aggregates.
flat("group_count", Order, lambda q: q.group_by("{orders.status}").set_fields(status="{orders.status}", n="COUNT(*)"), "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
flat("group_multi_key", OrderLine, lambda q: q.group_by("{lineitem.flag}", "{lineitem.number}").set_fields(flag="{lineitem.flag}", number="{lineitem.number}", n="COUNT(*)", q="SUM({lineitem.quantity})"), "SELECT l_returnflag AS flag, l_linenumber AS number, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2")
flat("group_class", NationStats, lambda q: q, "SELECT n_name AS nation_name, count(c_custkey) AS nation_customers, count(s_suppkey) AS nation_suppliers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
flat("group_sum_max", SegmentStats, lambda q: q, "SELECT c_mktsegment AS customer_segment, count(*) AS customer_n, round(sum(c_acctbal), 2) AS customer_total, max(c_acctbal) AS customer_largest FROM customer GROUP BY 1")
flat("group_order_by_agg", SegmentStats, lambda q: q.limit(2), "SELECT c_mktsegment AS customer_segment, count(*) AS customer_n, round(sum(c_acctbal), 2) AS customer_total, max(c_acctbal) AS customer_largest FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2")
flat("group_typed_where", Part, lambda q: q.where(q.f.size.between(1, 10)).group_by(q.f.size).set_fields(size="{part.size}", n="COUNT(*)", cheapest="MIN({part.price})"), "SELECT p_size AS size, count(*) AS n, min(p_retailprice) AS cheapest FROM part WHERE p_size BETWEEN 1 AND 10 GROUP BY 1")
flat("global_aggregate", Order, lambda q: q.set_fields(n="COUNT(*)", top="MAX({orders.total})"), "SELECT count(*) AS n, max(o_totalprice) AS top FROM orders")


@query("SELECT count(DISTINCT o_orderkey) AS total FROM orders")
def count_total(c: Catalog) -> DataFrame:
    return Query.of(OrderDetail, c).limit(3).count_df()


@query("SELECT count(DISTINCT o_orderkey) AS total FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 45")
def count_total_filtered_join(c: Catalog) -> DataFrame:
    return Query.of(OrderDetail, c).where("{lines.quantity} > ?", 45).count_df()


@query("SELECT count(*) AS total FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user')")
def count_total_composite(c: Catalog) -> DataFrame:
    q = Query.of(Turn, c)
    return q.where(q.f.role == "user").count_df()


# Order and limits: what is kept is what is compared.
flat("order_asc", Part, lambda q: q.select("id", "price").order_by(q.f.price.asc(), q.f.id).limit(7), "SELECT p_partkey AS part_id, p_retailprice AS part_price FROM part ORDER BY p_retailprice, p_partkey LIMIT 7")
flat("order_desc", Part, lambda q: q.select("id", "price").order_by("{part.price} DESC", "{part.id} ASC").limit(7), "SELECT p_partkey AS part_id, p_retailprice AS part_price FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 7")
flat("order_by_relation", Customer, lambda q: q.order_by(q.f.nation.name.desc(), q.f.id.asc()).limit(9).select("id", "nation.name"), f"SELECT c_custkey AS customer_id, n_name AS nation_name FROM {CUSTOMER_JOIN} ORDER BY n_name DESC, c_custkey LIMIT 9")
flat("order_nulls", Document, lambda q: q.order_by("{documents.labels.quality} ASC NULLS LAST", "{documents.doc_id}").limit(11).select("doc_id"), "SELECT d.doc_id AS documents_doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY quality ASC NULLS LAST, d.doc_id LIMIT 11")
flat("order_class_default", OrderedRegion, lambda q: q.limit(2), "SELECT r_regionkey AS region_id, r_name AS region_name FROM region ORDER BY r_name DESC LIMIT 2")
flat("limit_n", FlatCustomer, lambda q: q.order_by("{customer.id}").limit(5).select("id"), "SELECT c_custkey AS customer_id FROM customer ORDER BY 1 LIMIT 5")
flat("limit_offset", FlatCustomer, lambda q: q.order_by("{customer.id}").limit(10, 5).select("id"), "SELECT c_custkey AS customer_id FROM customer ORDER BY 1 LIMIT 5 OFFSET 10")
flat("topk_join", LineWithPart, lambda q: q.order_by("{lineitem.price} DESC", "{lineitem.order_key}", "{lineitem.number}", "{part.id}").limit(10).select("order_key", "price", "part.name"), "SELECT l_orderkey AS lineitem_order_key, l_extendedprice AS lineitem_price, p_name AS part_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, p_partkey LIMIT 10")
flat("limit_on_joined_rows", CustomerOrders, lambda q: q.order_by("{customer.id}", "{orders.id}").limit(25).select("id", "orders.id"), "SELECT c_custkey AS customer_id, o_orderkey AS orders_id FROM customer LEFT JOIN orders ON c_custkey = o_custkey ORDER BY 1, 2 LIMIT 25")


@query("SELECT o_orderkey AS id, count(l_orderkey)::BIGINT AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders) GROUP BY 1")
def first_row(c: Catalog) -> DataFrame:
    return Query.of(OrderDetail, c).first_df().select("id", F.size("lines").cast("long").alias("n"))


# Parts of a query replaced.
flat("replace_where", Part, lambda q: q.where(q.f.size.lt(3)).set_where(q.f.size.gt(40), "{part.price} < 1500").select("id"), "SELECT p_partkey AS part_id FROM part WHERE p_size > 40 AND p_retailprice < 1500")
flat("replace_joins", NationStats, lambda q: q.set_joins(ExtraJoin("inner", "region", "region", "{region}.r_regionkey = {this}.n_regionkey")).set_group_by().set_fields(id="{this}.n_nationkey", region="{region}.r_name"), "SELECT n_nationkey AS id, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey")
flat("replace_group_by", SegmentStats, lambda q: q.set_group_by("{this}.c_nationkey").set_order_by().set_fields(nation="{this}.c_nationkey", n="COUNT(*)"), "SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1")
flat("replace_order_by", OrderedRegion, lambda q: q.order_by("{region.name}").set_order_by(q.f.id.desc()).limit(2), "SELECT r_regionkey AS region_id, r_name AS region_name FROM region ORDER BY 1 DESC LIMIT 2")
flat("raw_date_functions", PlainOrder, lambda q: q.set_fields(id="{orders.id}", y="year({this}.o_orderdate)", m="month({this}.o_orderdate)", past="{this}.o_orderdate < now()"), "SELECT o_orderkey AS id, year(o_orderdate) AS y, month(o_orderdate) AS m, o_orderdate < now()::TIMESTAMP AS past FROM orders")
flat("where_uuid", FlatCustomer, lambda q: q.where(q.f.name.ne(UUID(int=1))).where("{customer.name} <> ?", UUID(int=2)).select("id"), "SELECT c_custkey AS customer_id FROM customer WHERE c_name <> '00000000-0000-0000-0000-000000000001' AND c_name <> '00000000-0000-0000-0000-000000000002'")


@query("SELECT n_nationkey AS nation_id, n_name AS nation_name FROM nation")
def proj_excluded(c: Catalog) -> DataFrame:
    """What isn't declared as a field is no column."""
    class Noted(Shape, table="nation"):
        id = Id(int, "n_nationkey")
        name = Col(str, "n_name")
        note: str = "kept by the program only"

    return Query.of(Noted, c).rows()


@query("SELECT 'a join needs a condition' AS message UNION ALL SELECT 'no order' UNION ALL SELECT 'cycle'")
def refused(c: Catalog) -> DataFrame:
    """A join without a condition, an order of what has none, and shapes that lead back to themselves."""
    class Ring(Shape, table="nation"):
        id = Id(int, "n_nationkey")
        flag = Col(bool)
        next = ToOne("Ring", "n_nationkey")

    class Flagged(Shape, table="nation"):
        id = Id(int, "n_nationkey")
        flag = Col(bool)

    said = []
    for mark, make in (("a join needs a condition", lambda: Query.of(Region, c).join("left", "nation", "n", "")), ("no order", lambda: Query.of(Flagged, c).f.flag.gt(True)), ("cycle", lambda: Query.of(Ring, c))):
        try:
            make()
        except (MappingError, TypeError) as e:
            said.append((mark if mark in str(e) else str(e),))
    return c.spark.createDataFrame(said, "message string")


# Entities.
@query("SELECT o_orderkey AS id, count(DISTINCT (l_linenumber, l_quantity, l_extendedprice, l_partkey, l_returnflag)) FILTER (l_orderkey IS NOT NULL)::BIGINT AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def fold_to_many_sizes(c: Catalog) -> DataFrame:
    return Query.of(OrderDetail, c).entities().select("id", F.size("lines").cast("long").alias("n"))


@query(f"SELECT c_custkey AS id, n_name AS nation, r_name AS region FROM {CUSTOMER_JOIN}")
def fold_shared_parent(c: Catalog) -> DataFrame:
    return Query.of(Customer, c).entities().select("id", F.col("nation.name").alias("nation"), F.col("nation.region.name").alias("region"))


@query("SELECT DISTINCT l_returnflag AS flag, l_linenumber AS number FROM lineitem")
def fold_no_id_dedup(c: Catalog) -> DataFrame:
    class Flag(Shape, table="lineitem"):
        flag = Col(str, "l_returnflag")
        number = Col(int, "l_linenumber")

    return Query.of(Flag, c).entities()


@query("SELECT c_custkey AS id, coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type), '') AS types FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1")
def fold_values_set(c: Catalog) -> DataFrame:
    return Query.of(CustomerEvents, c).entities().select("id", F.array_join("types", ",").alias("types"))


@query("SELECT c_custkey AS id, count(DISTINCT o_orderkey)::BIGINT AS n_orders, count(DISTINCT (l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_partkey, l_returnflag)) FILTER (l_orderkey IS NOT NULL)::BIGINT AS n_lines FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def fold_nested_two_level(c: Catalog) -> DataFrame:
    e = Query.of(CustomerTree, c).entities()
    lines = F.aggregate(F.transform("orders", lambda o: F.size(o["lines"]).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return e.select("id", F.size("orders").cast("long").alias("n_orders"), lines.alias("n_lines"))


@query("SELECT r_name AS name, string_agg(n_name, ',' ORDER BY n_nationkey) AS nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def fold_children_in_order(c: Catalog) -> DataFrame:
    return Query.of(RegionTree, c).entities().select("name", F.array_join(F.transform("nations", lambda n: n["name"]), ",").alias("nations"))


@query("SELECT o_orderkey AS id, count(DISTINCT l_partkey)::BIGINT AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 40 GROUP BY 1")
def fold_filtered_children(c: Catalog) -> DataFrame:
    """A condition on children removes parents that have none left, and the other children."""
    class OrderWithBigLines(Shape, table="orders"):
        id = Id(int, "o_orderkey")
        parts = ToMany(PartKey, "l_orderkey")

    return Query.of(OrderWithBigLines, c).where("{parts}.l_quantity > ?", 40).entities().select("id", F.size("parts").cast("long").alias("n"))


class PartKey(Shape, table="lineitem"):
    part_key = Id(int, "l_partkey")


@query("SELECT o_orderkey AS id, count(DISTINCT p_partkey)::BIGINT AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1")
def fold_many_to_many(c: Catalog) -> DataFrame:
    return Query.of(OrderParts, c).entities().select("id", F.size("parts").cast("long").alias("n"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'Document' ELSE 'LabeledDocument' END AS kind, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def fold_joined_subclass_type(c: Catalog) -> DataFrame:
    return Query.of(Document, c).entities().select("doc_id", F.col("_type").alias("kind"), "quality")


@query("SELECT event_id AS id, CASE event_type WHEN 'purchase' THEN 'Purchase' WHEN 'click' THEN 'Click' ELSE 'Event' END AS kind, value FROM events")
def fold_single_table_type(c: Catalog) -> DataFrame:
    return Query.of(Event, c).entities().select("id", F.col("_type").alias("kind"), "value")


@query("SELECT c_custkey AS id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS n_events FROM customer")
def fold_two_branches_no_product(c: Catalog) -> DataFrame:
    return Query.of(CustomerActivity, c).entities().select("id", F.size("orders").cast("long").alias("n_orders"), F.size("events").cast("long").alias("n_events"))


@query("SELECT c_custkey AS id, c_name AS name, count(o_orderkey)::BIGINT AS n, coalesce(sum(o_orderkey), 0)::BIGINT AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def stream_equals_batch(c: Catalog) -> DataFrame:
    """Entities with their children, one at a time."""
    rows = [(r.id, r.name, len(r.orders), sum(o.id for o in r.orders)) for r in iterate(Query.of(CustomerOrders, c))]
    return c.spark.createDataFrame(rows, "id long, name string, n long, keys long")


@query("SELECT row_number() OVER (ORDER BY c_mktsegment DESC, c_custkey) AS place, c_custkey AS id FROM customer")
def stream_order(c: Catalog) -> DataFrame:
    """Entities come in the query's order, then by id."""
    q = Query.of(FlatCustomer, c)
    rows = [(i + 1, r.id) for i, r in enumerate(iterate(q.order_by(q.f.segment.desc())))]
    return c.spark.createDataFrame(rows, "place long, id long")


@query("SELECT c_custkey AS id, lower(c_mktsegment) AS segment FROM customer")
def stream_converted(c: Catalog) -> DataFrame:
    """A field's converter is called for every entity that is streamed."""
    class LowerCustomer(Shape, table="customer"):
        id = Id(int, "c_custkey")
        segment = Col(str, "c_mktsegment", convert=str.lower)

    return c.spark.createDataFrame([(e["id"], e["segment"]) for e in iterate(Query.of(LowerCustomer, c), True)], "id long, segment string")


@query("SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders")
def stream_consumer(c: Catalog) -> DataFrame:
    keys: list[int] = []
    n = each(Query.of(PlainOrder, c), lambda r: keys.append(r.id))
    return c.spark.createDataFrame([(n, sum(keys))], "n long, keys long")


@query("SELECT c_custkey AS id, count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def fold_external_rows(c: Catalog) -> DataFrame:
    """Flat rows that the query didn't make, each twice."""
    q = Query.of(CustomerOrders, c)
    rows = raw.query(c, "SELECT c_custkey AS `customer.id`, c_name AS `customer.name`, o_orderkey AS `orders.id`, o_orderstatus AS `orders.status`, o_totalprice AS `orders.total`, o_custkey AS `orders.customer_key` FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
    return q.fold_rows(rows.union(rows)).select("id", F.size("orders").cast("long").alias("n"))


# Raw SQL.
@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_acctbal > 100 AND c_mktsegment <> 'what?' GROUP BY 1")
def raw_rows(c: Catalog) -> DataFrame:
    return raw.query(c, "SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_acctbal > ? AND c_mktsegment <> 'what?' GROUP BY 1", 100)


@query("SELECT p_partkey AS id FROM part WHERE p_size BETWEEN 5 AND 9 AND p_brand <> 'it''s'")
def raw_named_parameters(c: Catalog) -> DataFrame:
    return raw.query(c, "SELECT p_partkey AS id FROM part WHERE p_size BETWEEN :low AND :high AND p_brand <> :brand", low=5, high=9, brand="it's")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey = 1")
def raw_columns(c: Catalog) -> DataFrame:
    ids, names = raw.query_columns(c, "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = ?", 1)
    return c.spark.createDataFrame(list(zip(ids, names)), "id int, name string")


@query("SELECT count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer")
def raw_row_stream(c: Catalog) -> DataFrame:
    keys: list[int] = []
    n = raw.each_row(c, "SELECT c_custkey FROM customer", lambda r: keys.append(r[0]))
    return c.spark.createDataFrame([(n, sum(keys))], "n long, keys long")


@query("SELECT r_regionkey AS region_id, r_name AS region_name FROM region")
def scan_schema_qualified(c: Catalog) -> DataFrame:
    class OtherRegion(Shape, table="region", schema="elsewhere"):
        id = Id(int, "r_regionkey")
        name = Col(str, "r_name")

    return Query.of(OtherRegion, Catalog(c.spark).add("region", c.table("region"), "elsewhere")).rows()


@query("SELECT n_nationkey AS nation_id, n_name AS nation_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'")
def configured_engine(c: Catalog) -> DataFrame:
    class StoredRegion(Shape, table="REGION"):
        id = Id(int, "r_regionkey")
        name = Col(str, "r_name")

    class StoredNation(Shape, table="NATION"):
        id = Id(int, "n_nationkey")
        name = Col(str, "n_name")
        region = ToOne(StoredRegion, "n_regionkey")

    config = EngineConfig().named(str.lower).in_schema("kept").sized(input_bytes=1 << 20, cores=4)
    stored = Catalog(c.spark, config=config)
    for name in ("region", "nation"):
        stored.add(name, c.table(name), "kept")
    q = Query.of(StoredNation, stored)
    return q.select("id", "name").where(q.f.region.name == "ASIA").rows().toDF("nation_id", "nation_name")


@query("SELECT * FROM (VALUES ('nation', 'n_nationkey', 'int'), ('nation', 'n_name', 'string'), ('nation', 'n_regionkey', 'int'), ('region', 'r_regionkey', 'int'), ('region', 'r_name', 'string')) t(table_name, column_name, data_type)")
def catalog_columns(c: Catalog) -> DataFrame:
    return c.tables().filter("table_name IN ('nation', 'region')").select("table_name", "column_name", "data_type")


@query("SELECT event_id AS id, CAST(props->>'$.k' AS INTEGER) AS k FROM events")
def raw_json_field(c: Catalog) -> DataFrame:
    return Query.of(PlainEvent, c).set_fields(id="{events.id}", k="CAST(get_json_object({events}.props, '$.k') AS INT)").rows()


# Writes, as the table that results.
NEW_NATIONS = [(3, "THREE", 0), (90, "NINETY", 1), (91, "NINETY-ONE", 2)]


def _new(c: Catalog) -> DataFrame:
    return c.spark.createDataFrame(NEW_NATIONS, "n_nationkey int, n_name string, n_regionkey int")


VALUES = "(VALUES (3, 'THREE', 0), (90, 'NINETY', 1), (91, 'NINETY-ONE', 2)) v(n_nationkey, n_name, n_regionkey)"


@query(f"SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT * FROM {VALUES} WHERE n_nationkey > 3")
def write_insert(c: Catalog) -> DataFrame:
    return write.inserted(c.table("nation"), _new(c).filter("n_nationkey > 3"))


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT NULL, NULL")
def write_insert_without_values(c: Catalog) -> DataFrame:
    return write.inserted(c.table("region"), c.spark.createDataFrame([("x",)], "nothing string"))


@query("SELECT 'documents' AS table_name, doc_id, 'xx' AS value FROM (SELECT max(doc_id) + 1 AS doc_id FROM documents) UNION ALL SELECT 'labels', max(doc_id) + 1, '1' FROM documents")
def write_insert_two_tables(c: Catalog) -> DataFrame:
    """An entity of a joined subclass becomes a row of each table, under one id."""
    new = c.table("documents").agg(F.max("doc_id") + 1).first()[0]
    (docs, d), (labels, v) = write.extract(LabeledDocument, {"doc_id": new, "lang": "xx", "source": "s", "quality": 1, "toxic": 0})
    out = []
    for part, values, shown in ((docs, d, "lang"), (labels, v, "quality")):
        have = c.table(part.table)
        row = c.spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {have.schema[k].dataType.simpleString()}" for k in values))
        out.append(write.inserted(have, row).join(have.select("doc_id"), "doc_id", "left_anti").select(F.lit(part.table).alias("table_name"), F.col("doc_id").cast("long").alias("doc_id"), F.col(shown).cast("string").alias("value")))
    return out[0].union(out[1])


@query("SELECT r_regionkey, r_name FROM region UNION ALL VALUES (5, 'MOON'), (6, 'SUN')")
def write_insert_numbered(c: Catalog) -> DataFrame:
    new = c.spark.createDataFrame([("SUN",), ("MOON",)], "r_name string")
    return write.inserted(c.table("region"), write.numbered(c.table("region"), new, "r_regionkey", ["r_name"]))


@query("SELECT n_nationkey, CASE n_nationkey WHEN 3 THEN 'THREE' ELSE n_name END AS n_name, CASE n_nationkey WHEN 3 THEN 0 ELSE n_regionkey END AS n_regionkey FROM nation")
def write_update(c: Catalog) -> DataFrame:
    return write.updated(c.table("nation"), _new(c), ["n_nationkey"])


@query("SELECT n_nationkey, CASE n_nationkey WHEN 3 THEN 'fresh' ELSE n_name END AS n_name, CASE n_nationkey WHEN 3 THEN n_regionkey + 1 ELSE n_regionkey END AS n_regionkey FROM nation")
def write_version_conflict(c: Catalog) -> DataFrame:
    """The region's key serves as the version: the row of nation 3 is up to date, that of 4 is stale."""
    rows = c.table("nation").filter("n_nationkey in (3, 4)").select("n_nationkey", F.when(F.col("n_nationkey") == 3, "fresh").otherwise("stale").alias("n_name"), (F.col("n_regionkey") - (F.col("n_nationkey") == 4).cast("int")).alias("n_regionkey"))
    return write.versioned_update(c.table("nation"), rows, ["n_nationkey"], "n_regionkey")[0]


@query(f"SELECT coalesce(v.n_nationkey, n.n_nationkey) AS n_nationkey, coalesce(v.n_name, n.n_name) AS n_name, coalesce(v.n_regionkey, n.n_regionkey) AS n_regionkey FROM nation n FULL JOIN {VALUES} ON n.n_nationkey = v.n_nationkey")
def write_upsert(c: Catalog) -> DataFrame:
    return write.upserted(c.table("nation"), _new(c), ["n_nationkey"])


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey <> 3")
def write_delete(c: Catalog) -> DataFrame:
    return write.deleted(c.table("nation"), _new(c), ["n_nationkey"])


@query("""SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 0
UNION ALL SELECT n_nationkey, 'kept', 0 FROM nation WHERE n_nationkey = (SELECT max(n_nationkey) FROM nation WHERE n_regionkey = 0)
UNION ALL SELECT (SELECT max(n_nationkey) + 1 FROM nation), 'new', 0""")
def write_cascade_diff(c: Catalog) -> DataFrame:
    """Region 0's nations become one that is kept under a new name and a new one; the others go."""
    nation = c.table("nation")
    kept = nation.filter("n_regionkey = 0").agg(F.max("n_nationkey").alias("n_nationkey")).select("n_nationkey", F.lit("kept").alias("n_name"), F.lit(0).alias("n_regionkey"))
    new = c.spark.createDataFrame([(None, "new", 0)], "n_nationkey int, n_name string, n_regionkey int")
    return write.cascaded(nation, kept.unionByName(new), ["n_nationkey"], "n_regionkey", c.spark.createDataFrame([(0,)], "k int"))


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id <> (SELECT min(doc_id) FROM labels) UNION ALL SELECT (SELECT min(doc_id) FROM labels), 7, 8")
def write_link_sync(c: Catalog) -> DataFrame:
    labels = c.table("labels")
    parent = labels.agg(F.min("doc_id").alias("doc_id"))
    return write.links_synced(labels, parent.select("doc_id", F.lit(7).alias("quality"), F.lit(8).alias("toxic")), "doc_id", parent)


@query("SELECT 'lineitem' AS table_name, 'l_orderkey=7,l_linenumber=1,l_extendedprice=2.5,l_discount=0.5' AS pairs")
def write_extract(c: Catalog) -> DataFrame:
    """An entity's values by table, embedded ones under their columns."""
    parts = write.extract(LineMoney, {"order_key": 7, "number": 1, "money": {"price": 2.5, "discount": 0.5}})
    return c.spark.createDataFrame([(p.table, ",".join(f"{k}={v}" for k, v in values.items())) for p, values in parts], "table_name string, pairs string")


# Schemas.
@query("SELECT * FROM (VALUES ('team_member', 'team_id', 'bigint'), ('team_member', 'person_id', 'bigint'), ('team_color', 'team_id', 'bigint'), ('team_color', 'color', 'string')) t(table_name, column_name, data_type)")
def ddl_link_tables(c: Catalog) -> DataFrame:
    rows = [(t, f.name, f.dataType.simpleString()) for t, cols in schema.table_schemas(Team).items() if t.startswith("team_") for f in cols]
    return c.spark.createDataFrame(rows, "table_name string, column_name string, data_type string")


@query("SELECT * FROM (VALUES ('team', 'captain_id', 'person'), ('team_member', 'team_id', 'team'), ('team_member', 'person_id', 'person'), ('team_color', 'team_id', 'team')) t(table_name, column_name, target)")
def ddl_foreign_keys(c: Catalog) -> DataFrame:
    return c.spark.createDataFrame([(k.table, k.column, k.target) for k in schema.foreign_keys(Team)], "table_name string, column_name string, target string")


@query("SELECT * FROM (VALUES ('events', 'event_type', false)) t(table_name, column_name, nullable)")
def ddl_single_table(c: Catalog) -> DataFrame:
    """All variants share a table; what tells them apart allows no NULL."""
    rows = [(t, f.name, f.nullable) for t, cols in schema.table_schemas(Event).items() for f in cols if f.name == "event_type"]
    return c.spark.createDataFrame(rows, "table_name string, column_name string, nullable boolean")


@query("SELECT * FROM (VALUES ('documents', 'doc_id', 'bigint', false), ('documents', 'lang', 'string', true), ('documents', 'source', 'string', true), ('labels', 'doc_id', 'bigint', false), ('labels', 'quality', 'bigint', true), ('labels', 'toxic', 'bigint', true)) t(table_name, column_name, data_type, nullable)")
def ddl_columns(c: Catalog) -> DataFrame:
    rows = [(t, f.name, f.dataType.simpleString(), f.nullable) for t, cols in schema.table_schemas(Document).items() for f in cols]
    return c.spark.createDataFrame(rows, "table_name string, column_name string, data_type string, nullable boolean")


@query("SELECT * FROM (VALUES ('region', 'population'), ('moon', 'id')) t(table_name, column_name)")
def migration_missing_columns(c: Catalog) -> DataFrame:
    class Wider(Shape, table="region"):
        id = Id(int, "r_regionkey")
        population = Col(int)

    class Moon(Shape, table="moon"):
        id = Id(int)

    rows = [(t, f.name) for t, f in schema.missing_columns(c, Wider, Moon)]
    return c.spark.createDataFrame(rows, "table_name string, column_name string")


@query("SELECT l_orderkey AS order_key, l_linenumber AS number, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def check_duplicate_keys(c: Catalog) -> DataFrame:
    class KeyedLine(Shape, table="lineitem"):
        order_key = Id(int, "l_orderkey")
        number = Id(int, "l_linenumber")

    return schema.duplicate_keys(c, KeyedLine).select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("number"), "n")


@query("SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def check_orphans(c: Catalog) -> DataFrame:
    return schema.orphans(c, schema.ForeignKey("orders", "o_orderkey", "lineitem", "l_orderkey")).select(F.col("o_orderkey").alias("id"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: revenue by nation over a chain of four shapes."""
    return QUERIES["join_to_one_chain4"](spark, sf_dir)
