"""Plans need no session: alias trees, joins, output names, markers."""

import pytest

from lattica import Col, Embedded, ExtraJoin, Id, MappingError, Select, Shape, Through, ToMany, ToOne, Values
from lattica.plans.compiler import compile_shape
from lattica.plans.markers import MarkerError, bind, literal, named_parameters, resolve
from lattica.queries import Customer, Document, Event, LabeledDocument, OrderParts


class Country(Shape, table="country"):
    id = Id(int)
    name = Col(str)


class Address(Shape):
    street = Col(str)
    city = Col(str)
    country = ToOne(Country)


class Personal(Shape):
    phone = Col(str)
    home = Embedded(Address)


class Client(Shape, table="client"):
    id = Id(int)
    personal = Embedded(Personal)


class Mail(Shape, table="mail"):
    client_id = Col(int)
    email = Col(str)


class Person(Shape, table="person"):
    id = Id(int, "person_key")
    first = Col(str, "firstname")
    mails = ToMany(Mail, "person_id")


class Happening(Shape, table="happening"):
    id = Id(int)
    persons = Through(Person, "happening_person")
    tags = Values(str, "happening_tag", "tag")


def names(shape):
    return [o.name for o in compile_shape(shape).outputs]


def joins(shape):
    return [(j.how, j.table, j.alias, j.on) for j in compile_shape(shape).joins]


def test_to_one_chain():
    assert names(Customer) == ["customer.id", "customer.name", "customer.balance", "customer.segment", "nation.id", "nation.name", "nation.region.id", "nation.region.name"]
    assert joins(Customer) == [("left", "nation", "nation", "`customer`.`c_nationkey` = `nation`.`n_nationkey`"), ("left", "region", "nation.region", "`nation`.`n_regionkey` = `nation.region`.`r_regionkey`")]


def test_embedded_prefixes_nest():
    plan = compile_shape(Client)
    assert [(o.name, o.column) for o in plan.outputs] == [("client.id", "id"), ("personal.phone", "personal_phone"), ("personal.home.street", "personal_home_street"), ("personal.home.city", "personal_home_city"), ("personal.home.country.id", "id"), ("personal.home.country.name", "name")]
    assert joins(Client) == [("left", "country", "personal.home.country", "`client`.`personal_home_country_id` = `personal.home.country`.`id`")]


def test_many_to_many_and_values():
    assert joins(Happening) == [
        ("left", "happening_person", "happening_persons", "`happening`.`id` = `happening_persons`.`happening_id`"),
        ("left", "person", "persons", "`happening_persons`.`person_id` = `persons`.`person_key`"),
        ("left", "mail", "persons.mails", "`persons`.`person_key` = `persons.mails`.`person_id`"),
        ("left", "happening_tag", "tags", "`happening`.`id` = `tags`.`happening_id`"),
    ]


def test_inheritance_joins():
    assert joins(LabeledDocument) == [("inner", "documents", "documents", "`documents`.`doc_id` = `labels`.`doc_id`")]
    assert names(LabeledDocument) == ["labels.quality", "labels.toxic", "labels.doc_id", "labels.lang", "labels.source"]
    assert joins(Document) == [("left", "labels", "documents.labels", "`documents.labels`.`doc_id` = `documents`.`doc_id`")]
    assert joins(Event) == []
    assert names(Event) == ["events.id", "events.user_key", "events.value", "events.event_type", "events.props", "events.ts"]


def test_linked_base_is_left_joined():
    class Holder(Shape, table="holder"):
        id = Id(int)
        items = ToMany(LabeledDocument, "holder_id")

    assert joins(Holder) == [("left", "labels", "items", "`holder`.`id` = `items`.`holder_id`"), ("left", "documents", "items.documents", "`items.documents`.`doc_id` = `items`.`doc_id`")]


def test_cycle():
    class Boss(Shape, table="boss"):
        id = Id(int)
        staff = ToMany("Worker")

    class Worker(Shape, table="worker"):
        id = Id(int)
        boss = ToOne(Boss)

    with pytest.raises(MappingError, match="Mapping cycle detected: Boss -> Worker -> Boss"):
        compile_shape(Boss)


def test_schema_and_extra_joins():
    class Story(Shape, table="story", schema="s1", joins=[ExtraJoin("inner", "author", "writer", "{this}.author_name = {writer}.name", "s2")]):
        id = Id(int)
        writer_name = Select("{writer}.name")

    plan = compile_shape(Story)
    assert plan.schema == "s1" and plan.joins[0].schema == "s2" and plan.joins[0].on == "`story`.author_name = `writer`.name"
    assert plan.lookup("writer_name") == "(`writer`.name)"


def test_markers():
    plan = compile_shape(OrderParts)
    assert plan.text("{this}.o_orderkey = {parts.id} AND '{parts.id}' <> {orders.id}") == "`orders`.o_orderkey = `parts`.`p_partkey` AND '{parts.id}' <> `orders`.`o_orderkey`"
    with pytest.raises(MarkerError):
        plan.text("{nowhere.at}")
    assert resolve("{a}", lambda n: "$1\\2") == "$1\\2"


def test_computed_field_that_refers_to_itself():
    class Loop(Shape, table="loop"):
        id = Id(int)
        a = Select("{loop.b} + 1")
        b = Select("{loop.a} + 1")

    with pytest.raises(MappingError):
        compile_shape(Loop).lookup("a")


def test_binding():
    assert bind("a = ? AND b <> '?' AND c = ?", [1, "it's \\ ok"]) == "a = 1L AND b <> '?' AND c = 'it\\'s \\\\ ok'"
    for params in ([], [1, 2, 3]):
        with pytest.raises(MarkerError):
            bind("a = ? AND b = ?", params)
    with pytest.raises(MarkerError):
        bind("a = 'open", [])
    with pytest.raises(MarkerError):
        literal(object())
    assert named_parameters("x = :one AND y = '?:no' AND z = ?") == [":one", "?"]
