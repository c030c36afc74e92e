"""Search and contest payloads as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlake.functions import text as T

_RESULT = "struct<title:string,link:string,snippet:string,position:int,displayed_link:string,date:string>"
_BOX = "struct<title:string,link:string,answer:string,snippet:string,result:string>"
_GRAPH = "struct<title:string,website:string,type:string,description:string>"


def _items(text: Column, path: str, kind: str) -> Column:
    """The objects at a path that holds an object or an array; what isn't an object goes."""
    raw = F.get_json_object(text, path)
    many = F.when(raw.startswith("["), F.from_json(raw, "array<variant>"))
    objects = F.filter(F.transform(many, lambda v: F.to_json(v)), lambda s: s.startswith("{"))
    return F.when(raw.startswith("{"), F.array(F.from_json(raw, kind))).otherwise(F.transform(objects, lambda s: F.from_json(s, kind)))


def search_results(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """key, rank, title, url, snippet, source_type, source_position: the answer box, the knowledge panel and the results of each
    payload in this order; without blank snippets; a URL once; titles fall back to the URL."""
    text = F.col(payload)
    named = lambda title, url, snippet, source, position: F.struct(title.alias("title"), url.alias("url"), snippet.alias("snippet"), F.lit(source).alias("source_type"), position.alias("source_position"))
    none = F.lit(None).cast("int")
    boxes = F.transform(_items(text, "$.answer_box", _BOX), lambda b: named(F.coalesce(b["title"], F.lit("Google 精选摘要")), b["link"], T.first_truthy(b["answer"], b["snippet"], b["result"]), "answer_box", none))
    graph = F.transform(_items(text, "$.knowledge_graph", _GRAPH), lambda g: named(F.coalesce(g["title"], F.lit("Google 知识面板")), g["website"], F.concat_ws("；", F.nullif(g["type"], F.lit("")), F.nullif(g["description"], F.lit(""))), "knowledge_graph", none))
    organic = F.transform(_items(text, "$.organic_results", _RESULT), lambda r: named(r["title"], r["link"], r["snippet"], "organic_results", F.when(r["position"] >= 1, r["position"])))
    empty = F.array().cast("array<struct<title:string,url:string,snippet:string,source_type:string,source_position:int>>")
    rows = payloads.select(key, F.posexplode(F.concat(*[F.coalesce(x, empty) for x in (boxes, graph, organic)])).alias("pos", "r")).select(key, "pos", "r.*")
    clean = rows.select(key, "pos", T.first_truthy(T.strip(F.col("title")), T.strip(F.col("url")), F.lit("网页搜索结果")).alias("title"), F.nullif(T.strip(F.col("url")), F.lit("")).alias("url"), T.strip(F.col("snippet")).alias("snippet"), "source_type", "source_position").where("snippet <> ''")
    once = clean.withColumn("__n", F.row_number().over(Window.partitionBy(key, F.coalesce("url", F.concat(F.lit("#"), "pos"))).orderBy("pos"))).where("__n = 1").drop("__n")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).drop("pos")


def contest_number(title: Column, upcoming: Column, target: Column) -> Column:
    """The number of the weekly contest on a date, counted back in weeks from the upcoming one; null if it is too far."""
    number = F.nullif(F.regexp_extract(title, "([0-9]{2,3})$", 1), F.lit("")).cast("int")
    days = F.date_diff(upcoming, target)
    back = F.greatest(F.lit(0), F.bround(days / 7.0).cast("int"))
    return F.when(F.lower(title).startswith("weekly contest"), F.when(target.isNull(), number).when(days.between(-1, 35), number - back))
