"""JSON documents and documents of a small part of YAML, by fixed schemas; whatever is not listed is refused.

The part of YAML: a line is ``name: scalar``, or ``name:`` with lines ``  - scalar`` or ``  name: scalar``
below it, or ``[]`` or ``{}`` for an empty one; a scalar is a text in double quotes, a whole number,
true, false, null, or plain words that begin with a letter. Lines are rewritten as JSON, each by what stands
next to it, so both formats are read, and repeated members found, by the same parser. A document is as long
as its file and is put together in one task; documents are spread over all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TYPES = ("string", "integer", "boolean", "list", "map")
#: How a line is cut into indent, dash, name and value, and what a scalar may look like.
_LINE = r"^(  )?(- )?(?:([A-Za-z_][A-Za-z0-9_]*):(?: |$))?(.*)$"
_TEXT, _WHOLE, _WORD, _PLAIN = r'^"(?:[^"\\]|\\.)*"$', r"^-?(?:0|[1-9][0-9]{0,17})$", r"^(?:true|false|null)$", r"^[A-Za-z/][A-Za-z0-9_./@+-]*(?: [A-Za-z0-9_./@+-]+)*$"
#: Plain words that readers of YAML take for truth values or nothing.
_DOUBTFUL = r"(?i)^(?:y|n|yes|no|on|off|true|false|null)$"
_MARKS = (("anchor", r"^[&*]"), ("tag", r"^!"), ("flow", r"^[\[{]"), ("block", r"^[|>]"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc, text of every file below a folder; the name tells the format (.json, .yaml or .yml)."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.input_file_name().alias("doc"), F.col("value").alias("text"))


def _scalar(v: Column) -> Column:
    return F.when(v.rlike(_TEXT) | v.rlike(_WHOLE) | v.rlike(_WORD) | v.isin("[]", "{}"), v).when(v.rlike(_PLAIN) & ~v.rlike(_DOUBTFUL), F.concat(F.lit('"'), v, F.lit('"')))


def as_json(docs: DataFrame) -> DataFrame:
    """doc, json and refused of YAML documents (doc, text); refused are reasons in order of name, joined by commas, and then json is null.

    A null text, or one without a member, is empty. doc must be unique.
    """
    lines = docs.select("doc", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("place", "line"))
    lines = lines.filter(~F.col("line").rlike(r"^\s*(#.*)?$"))
    part = lambda k: F.regexp_extract("line", _LINE, k)
    rows = lines.select("doc", "place", "line", (part(1) != "").alias("deep"), (part(2) != "").alias("item"), part(3).alias("name"), F.rtrim(part(4)).alias("v"))
    header = ~F.col("deep") & (F.col("name") != "") & (F.col("v") == "")
    kind = F.when(header, "header").when(F.col("deep") & F.col("item") & (F.col("name") == ""), "item").when(F.col("deep") & ~F.col("item") & (F.col("name") != ""), "member").when(~F.col("deep") & ~F.col("item") & (F.col("name") != ""), "scalar")
    w = Window.partitionBy("doc").orderBy("place")
    rows = rows.withColumn("kind", kind).withColumns({"before": F.lag("kind").over(w), "after": F.lead("kind").over(w), "json": _scalar(F.col("v")), "first": F.row_number().over(w) == 1})
    nested = F.col("kind").isin("item", "member")
    opens = F.coalesce(F.col("after").isin("item", "member"), F.lit(False))
    found = [F.when(F.col("v").rlike(p), n) for n, p in _MARKS if n != "flow"] + [F.when(F.col("v").rlike(_MARKS[2][1]) & ~F.col("v").isin("[]", "{}"), "flow")]
    wrong = [
        *found, F.when(F.contains("line", F.lit("\t")), "tab"), F.when(F.col("line").rlike(r"^(---|\.\.\.|%)"), "marker"), F.when(F.col("kind").isNull(), "line"), F.when(nested & ~F.coalesce(F.col("before").isin("header") | (F.col("before") == F.col("kind")), F.lit(False)), "indent"),
        F.when((F.col("kind") == "header") & ~opens, "value"), F.when((F.col("kind") != "header") & F.col("json").isNull(), "scalar"), F.when(nested & F.col("v").isin("[]", "{}"), "flow"),
    ]
    comma = F.when(F.col("first") | (nested & (F.col("before") == "header")), "").otherwise(",")
    named = F.concat(F.lit('"'), F.col("name"), F.lit('":'))
    last = ~F.coalesce(F.col("after") == F.col("kind"), F.lit(False))
    piece = (
        F.when(F.col("kind") == "header", F.concat(comma, named, F.when(F.col("after") == "item", "[").otherwise("{"))).when(F.col("kind") == "item", F.concat(comma, "json", F.when(last, "]").otherwise("")))
        .when(F.col("kind") == "member", F.concat(comma, named, "json", F.when(last, "}").otherwise(""))).otherwise(F.concat(comma, named, "json"))
    )
    made = rows.select("doc", "place", piece.alias("piece"), F.array_compact(F.array(*wrong)).alias("wrong"))
    g = made.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda p: p["piece"]), "").alias("body"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("wrong")))).alias("wrong"))
    refused = F.when(F.col("wrong").isNull(), F.lit("empty")).otherwise(F.array_join("wrong", ","))
    g = docs.select("doc").join(g, "doc", "left").select("doc", F.concat(F.lit("{"), "body", F.lit("}")).alias("json"), refused.alias("refused"))
    return g.select("doc", F.when(F.col("refused") == "", F.col("json")).alias("json"), "refused")


def _is(type_: str, schema: Column) -> Column:
    return {"string": schema == "STRING", "integer": schema == "BIGINT", "boolean": schema == "BOOLEAN", "list": schema.startswith("ARRAY<"), "map": schema.startswith("OBJECT<")}[type_]


def checked(docs: DataFrame, schema: dict[str, str]) -> DataFrame:
    """doc, value (a variant) and refused of documents (doc, text, format): JSON or YAML of a schema, member to type.

    All members are needed and no others taken. A repeated member, at any depth, is refused like text that
    does not parse. A document that is refused has no value.
    """
    yaml = as_json(docs.filter("format = 'yaml'"))
    plain = docs.filter("format = 'json'").select("doc", F.col("text").alias("json"), F.lit("").alias("refused"))
    other = docs.filter("format is null or format not in ('json', 'yaml')").select("doc", F.lit(None).cast("string").alias("json"), F.lit("format").alias("refused"))
    rows = plain.unionByName(yaml).unionByName(other).withColumn("value", F.try_parse_json("json"))
    keys = F.json_object_keys("json")
    of = lambda name: F.schema_of_variant(F.try_variant_get("value", f"$.{name}", "variant"))
    names = F.array(*map(F.lit, schema))
    typed = reduce(Column.__and__, [F.coalesce(_is(t, of(n)), F.lit(False)) for n, t in schema.items()])
    reason = F.when(F.col("refused") != "", F.col("refused")).when(F.col("value").isNull() | keys.isNull(), "parse").when(F.size(F.array_except(keys, names)) > 0, "unknown").when(F.size(F.array_except(names, keys)) > 0, "missing").when(~typed, "type").otherwise("")
    return rows.select("doc", "value", reason.alias("refused")).select("doc", F.when(F.col("refused") == "", F.col("value")).alias("value"), "refused")


def member(name: str, type_: str = "string") -> Column:
    """A member of a checked document, or what lies at a path in it."""
    return F.try_variant_get("value", f"$.{name}", type_)


def _said(c: Column, type_: str) -> Column:
    text = F.to_json(F.array(c))
    return F.substring(text, F.lit(2), F.length(text) - 2) if type_ == "string" else F.coalesce(c.cast("string"), F.lit("null"))


def rendered(schema: dict[str, str], **columns: Column) -> Column:
    """The YAML text of columns: lists and maps are of strings, and maps are in order of their keys."""
    parts = []
    for name, type_ in schema.items():
        c = columns[name]
        if type_ == "list":
            parts.append(F.when(F.size(c) == 0, f"{name}: []").otherwise(F.concat(F.lit(f"{name}:\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("  - "), _said(x, "string"))), "\n"))))
        elif type_ == "map":
            entries = F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), _said(e["value"], "string")))
            parts.append(F.when(F.size(c) == 0, f"{name}: {{}}").otherwise(F.concat(F.lit(f"{name}:\n"), F.array_join(entries, "\n"))))
        else:
            parts.append(F.concat(F.lit(f"{name}: "), _said(c, type_)))
    return F.concat_ws("\n", *parts, F.lit(""))


#: Members of a task's recorded state.
STATE = {"task_id": "string", "phase": "string", "run_epoch": "integer", "paused": "boolean", "sources": "list", "budgets": "map"}
QUERIES = {
    "state_documents": (
        lambda t: checked(t("state_files"), STATE).select(F.col("doc"), "refused", member("phase").alias("phase"), member("run_epoch", "long").alias("run_epoch"), member("paused", "boolean").alias("paused"), member("sources[1]").alias("second"), member("budgets.pages", "long").alias("pages")),
        """SELECT 'd' || CAST(event_id AS STRING) AS doc, bad AS refused, CASE WHEN bad = '' THEN CASE WHEN event_id % 8 = 4 THEN 'say "' || event_type || '" twice' ELSE event_type END END AS phase, CASE WHEN bad = '' THEN user_id END AS run_epoch, CASE WHEN bad = '' THEN event_id % 4 = 0 END AS paused,
          CASE WHEN bad = '' THEN 's' || CAST(event_id % 7 AS STRING) END AS second, CASE WHEN bad = '' THEN event_id % 6 END AS pages FROM (SELECT *, CASE event_id % 29 WHEN 1 THEN 'parse' WHEN 2 THEN 'unknown' WHEN 3 THEN 'type' WHEN 4 THEN CASE WHEN event_id % 2 = 0 THEN 'anchor,scalar' ELSE 'parse' END WHEN 5 THEN CASE WHEN event_id % 2 = 0 THEN 'scalar,tag' ELSE 'parse' END WHEN 6 THEN 'missing' ELSE '' END AS bad FROM events) e""",
    ),
}
