"""The test tables read as quads. Each predicate belongs to one table, so patterns about a subject are one scan."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions import terms as t
from ..sources.mapping import EX, Object, Quads, Table


def _text(c: str) -> Object:
    return Object(c)


def _int(c: str) -> Object:
    return Object(c, dt=t.INTEGER)


def _double(c: str) -> Object:
    return Object(c, dt=t.DOUBLE)


def _ref(c: str, table: str) -> Object:
    return Object(c, prefix=f"{EX}{table}/")


#: Table: (key columns, predicate by column). Foreign keys become IRIs.
TABLES = {
    "region": (["r_regionkey"], {"region_name": _text("r_name")}),
    "nation": (["n_nationkey"], {"nation_name": _text("n_name"), "region": _ref("n_regionkey", "region")}),
    "customer": (["c_custkey"], {"customer_name": _text("c_name"), "customer_nation": _ref("c_nationkey", "nation"), "customer_acctbal": _double("c_acctbal"), "segment": _text("c_mktsegment")}),
    "supplier": (["s_suppkey"], {"supplier_name": _text("s_name"), "supplier_nation": _ref("s_nationkey", "nation"), "supplier_acctbal": _double("s_acctbal")}),
    "part": (["p_partkey"], {"part_name": _text("p_name"), "brand": _text("p_brand"), "type": _text("p_type"), "size": _int("p_size"), "price": _double("p_retailprice")}),
    "orders": (
        ["o_orderkey"],
        {"cust": _ref("o_custkey", "customer"), "status": _text("o_orderstatus"), "total": _double("o_totalprice"), "date": Object("o_orderdate", dt=t.DATETIME), "priority": _text("o_orderpriority")},
    ),
    "lineitem": (
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
        {
            "order": _ref("l_orderkey", "orders"), "part": _ref("l_partkey", "part"), "supp": _ref("l_suppkey", "supplier"), "linenumber": _int("l_linenumber"), "quantity": _double("l_quantity"),
            "extendedprice": _double("l_extendedprice"), "discount": _double("l_discount"), "returnflag": _text("l_returnflag"), "shipdate": Object("l_shipdate", dt=t.DATETIME),
        },
    ),
    "events": (["event_id"], {"ts": Object("ts", dt=t.DATETIME), "user": _int("user_id"), "event_type": _text("event_type"), "value": _double("value")}),
    "documents": (["doc_id"], {"text": Object("text", lang="lang"), "source": _text("source"), "n_chars": _int("n_chars")}),
    "labels": (["doc_id"], {"quality": _int("quality"), "toxic": _int("toxic")}),
    "conversations": (["conv_id", "turn"], {"role": _text("role"), "turn": _int("turn"), "next": Object("next", prefix=f"{EX}conversations/")}),
}



def quads(spark: SparkSession, sf_dir: str, *names: str, default_graph: str = "union") -> Quads:
    """The named tables as quads."""
    out = []
    for name in names:
        key, columns = TABLES[name]
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "conversations":
            following = df.selectExpr("conv_id as c", "turn - 1 as t").distinct()
            df = df.join(following, (df["conv_id"] == following["c"]) & (df["turn"] == following["t"]), "left").selectExpr("conv_id", "turn", "role", "case when t is not null then concat_ws('/', conv_id, turn + 1) end as next")
        out.append(Table(df, name, key, {EX + p: o for p, o in columns.items()}, blank=name == "lineitem", subject_of="documents" if name == "labels" else None))
    return Quads(out, default_graph)
