"""Deeply nested records to flat tables by Dewey labelling.

A record's JSON columns are parsed once into VARIANT; every node gets its Dewey label (the ordinals on the way
from the root) and its step path.  The parent link is the label with its last step cut off.  The schema path is the
step path without its ordinals and numbers; by it the nodes fall into flat tables, which get their columns from the
fields that are found.  Everything stays in JVM expressions: one narrow pass, no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.ids import evidence_ids

#: Ends the wrapped text below; a text that itself holds it is not taken for valid JSON.
SENTINEL = "␞ memloom end of text ␞"

#: Node kind, and so table, of each schema path.
KIND_OF_SCHEMA_PATH = {
    "conversation": "conversation",
    "conversation.session_*": "session",
    "conversation.session_*[]": "turn",
    "conversation.session_*[].img_url[]": "image",
    "qa[]": "qa",
    "qa[].evidence[]": "evidence",
}

#: Keys whose values are tables of their own.
CHILD_KEYS = ("img_url", "evidence")
SESSION_KEY = r"^session_\d+\z"
SESSION_FIELD = r"^session_\d+(_.*)?\z"

NODE_COLUMNS = ("record_id", "node_kind", "node_path", "parent_path", "node_key")


def allow_duplicate_keys(df: DataFrame) -> None:
    """Let the last of two equal keys of an object win, as JSON readers commonly do (a session setting)."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def with_whole_json(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each text column becomes the VARIANT of a text that is valid JSON from its first to its last character, else null.

    The parser stops after the first value, so the text is wrapped into an array that ends in a sentinel:
    anything after the first value either breaks the array or changes its length.  A JSON string that holds
    JSON is unwrapped once.  The steps are projections of their own, so that no text is parsed twice.
    """

    def items(t: Column) -> Column:
        wrapped = F.try_parse_json(F.concat(F.lit("["), t, F.lit(f',"{SENTINEL}"]')))
        return F.try_variant_get(wrapped, "$", "array<variant>")

    def whole(w: Column) -> Column:
        return F.when((F.size(w) == 2) & (F.try_variant_get(w[1], "$", "string") == SENTINEL), w[0])

    df = df.withColumns({c: items(F.col(c)) for c in columns})
    df = df.withColumns({c: whole(F.col(c)) for c in columns})
    kinds = {f"_{c}_inner": F.when(F.schema_of_variant(F.col(c)) == "STRING", F.try_variant_get(F.col(c), "$", "string")) for c in columns}
    df = df.withColumns(kinds)
    df = df.withColumns({f"_{c}_items": items(F.col(f"_{c}_inner")) for c in columns})
    df = df.withColumns({c: F.when(F.col(f"_{c}_inner").isNull(), F.col(c)).otherwise(whole(F.col(f"_{c}_items"))) for c in columns})
    return df.drop(*kinds, *[f"_{c}_items" for c in columns])


def _there(v: Column) -> Column:
    return v.isNotNull() & ~F.is_variant_null(v)


def _as_array(v: Column) -> Column:
    """Elements of an array; a lone value is an array of one, null or missing an empty one."""
    return F.coalesce(
        F.try_variant_get(v, "$", "array<variant>"),
        F.when(_there(v), F.array(v)),
        F.array().cast("array<variant>"),
    )


def _text(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def schema_path(node_path: Column) -> Column:
    """``conversation/session_3/0/img_url/1`` -> ``conversation.session_*[].img_url[]``."""
    listed = F.regexp_replace(node_path, r"/\d+(?=/|\z)", "[]")
    return F.regexp_replace(F.regexp_replace(listed, r"_\d+(?=\[|/|\z)", "_*"), "/", ".")


def _kind(node_path: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in KIND_OF_SCHEMA_PATH.items() for x in pair])
    return F.try_element_at(kinds, schema_path(node_path))


def _node(dewey: Column, steps: Column, key: Column, value: Column, beside: Column | None = None) -> Column:
    none = F.lit(None).cast("map<string,variant>")
    return F.struct(dewey.alias("dewey"), steps.alias("steps"), key.alias("node_key"), value.alias("value"), (none if beside is None else beside).alias("beside"))


def _ordinal(i: Column) -> Column:
    return i.cast("string")


def _conversation_nodes(doc: Column, fields: bool) -> Column:
    known = F.try_variant_get(doc, "$", "map<string,variant>")
    sessions = F.filter(F.map_entries(known), lambda e: e["key"].rlike(SESSION_KEY) & _there(e["value"]))

    def of_session(e: Column) -> Column | None:
        """Fields of the conversation that are named after a session are the session's."""
        if not fields:
            return None
        own = F.filter(F.map_entries(known), lambda x: x["key"].startswith(F.concat(e["key"], F.lit("_"))))
        return F.map_from_entries(F.transform(own, lambda x: F.struct(F.substring(x["key"], F.length(e["key"]) + 2, F.length(x["key"])).alias("key"), x["value"].alias("value"))))

    def image(steps: Column, dewey: Column):
        return lambda v, i: F.when(
            _there(v),
            _node(F.concat(dewey, F.array(i)), F.concat(steps, F.array(F.concat(F.lit("img_url/"), _ordinal(i)))), _text(v, "$"), v),
        )

    def turn(steps: Column, dewey: Column):
        def build(v: Column, i: Column) -> Column:
            own_steps, own_dewey = F.concat(steps, F.array(_ordinal(i))), F.concat(dewey, F.array(i))
            images = F.transform(_as_array(F.try_variant_get(v, "$.img_url", "variant")), image(own_steps, own_dewey))
            return F.when(_there(v), F.concat(F.array(_node(own_dewey, own_steps, _text(v, "$.dia_id"), v)), images))

        return build

    def session(e: Column, i: Column) -> Column:
        steps, dewey = F.array(F.lit("conversation"), e["key"]), F.array(F.lit(0), i)
        turns = F.filter(F.transform(_as_array(e["value"]), turn(steps, dewey)), lambda x: x.isNotNull())
        return F.concat(F.array(_node(dewey, steps, e["key"], e["value"], of_session(e))), F.flatten(turns))

    found = F.flatten(F.transform(sessions, session))
    if not fields:
        return found
    own = F.map_filter(known, lambda k, v: ~k.rlike(SESSION_FIELD))
    return F.concat(F.array(_node(F.array(F.lit(0)), F.array(F.lit("conversation")), F.lit(""), F.lit(None).cast("variant"), own)), found)


def _qa_nodes(doc: Column) -> Column:
    def question(v: Column, i: Column) -> Column:
        steps, dewey = F.array(F.lit("qa"), _ordinal(i)), F.array(F.lit(1), i)
        entries = F.transform(_as_array(F.try_variant_get(v, "$.evidence", "variant")), lambda e: F.try_variant_get(e, "$", "string"))
        evidence = F.transform(
            evidence_ids(entries),
            lambda d, j: _node(F.concat(dewey, F.array(j)), F.concat(steps, F.array(F.concat(F.lit("evidence/"), _ordinal(j)))), d, F.lit(None).cast("variant")),
        )
        return F.when(_there(v), F.concat(F.array(_node(dewey, steps, _text(v, "$.category"), v)), evidence))

    return F.flatten(F.filter(F.transform(_as_array(doc), question), lambda x: x.isNotNull()))


def shred(df: DataFrame, *, id_col: str = "record_id", conversation: str = "conversation", qa: str = "qa", fields: bool = False) -> DataFrame:
    """All nodes of all records: ``record_id, node_kind, node_path, parent_path, node_key, dewey, value``.

    * A text that is null, empty or not wholly valid JSON gives no nodes of its column; the other column counts.  So
      does a text beyond the size limit of VARIANT (16 MB here, set by Spark): ``unreadable`` lists both kinds.
    * ``conversation`` must be an object, ``qa`` an array (or one object); any other value has no nodes.
    * Null elements keep their ordinal and give no node; a missing or null key is the empty string.
    * Equal records under two ids, and repeated rows, give their nodes each; a null id stays null.
    * Columns of the input beside the three named ones are not read.

    With ``fields`` there is also a node for each conversation, and ``value`` is replaced by the node's fields:
    ``scalars`` (map of texts) and ``nested`` (map of JSON texts); null values are no fields.
    """
    allow_duplicate_keys(df)
    docs = df.select(F.col(id_col).alias("record_id"), F.col(conversation).alias("c"), F.col(qa).alias("q"))
    docs = with_whole_json(docs, ["c", "q"])
    none = F.array().cast("array<struct<dewey:array<int>,steps:array<string>,node_key:string,value:variant,beside:map<string,variant>>>")
    is_object = F.schema_of_variant(F.col("c")).startswith("OBJECT")
    c = F.when(is_object, F.filter(_conversation_nodes(F.col("c"), fields), lambda x: x.isNotNull()))
    nodes = docs.select("record_id", F.inline(F.concat(F.coalesce(c, none), F.coalesce(_qa_nodes(F.col("q")), none))))
    nodes = nodes.select(
        "record_id",
        F.array_join("steps", "/").alias("node_path"),
        F.array_join(F.slice("steps", F.lit(1), F.size("steps") - 1), "/").alias("parent_path"),
        "node_key",
        "dewey",
        "value",
        "beside",
    )
    nodes = nodes.select("record_id", _kind(F.col("node_path")).alias("node_kind"), *nodes.columns[1:])
    if not fields:
        return nodes.drop("beside")
    is_scalar = lambda v: ~F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)")
    own = F.map_filter(F.coalesce("beside", F.try_variant_get("value", "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")), lambda k, v: _there(v) & ~k.isin(*CHILD_KEYS))
    nodes = nodes.withColumn("own", own)
    scalars = F.transform_values(F.map_filter("own", lambda k, v: is_scalar(v)), lambda k, v: F.try_variant_get(v, "$", "string"))
    nested = F.transform_values(F.map_filter("own", lambda k, v: ~is_scalar(v)), lambda k, v: F.to_json(v))
    return nodes.select("record_id", "node_kind", "node_path", "parent_path", "node_key", "dewey", scalars.alias("scalars"), nested.alias("nested"))


def unreadable(df: DataFrame, *, id_col: str = "record_id", columns: tuple[str, ...] = ("conversation", "qa")) -> DataFrame:
    """``record_id, column, n_chars`` of the texts that give no nodes though something stands in them: no JSON, or beyond VARIANT's size."""
    allow_duplicate_keys(df)
    sized = df.select(F.col(id_col).alias("record_id"), *columns, *[F.length(c).alias(f"_n_{c}") for c in columns])
    parsed = with_whole_json(sized, list(columns))
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_n_{c}").cast("bigint").alias("n_chars"), F.col(c).isNull().alias("bad")) for c in columns])
    return parsed.select("record_id", F.inline(each)).filter("bad and n_chars > 0").drop("bad")


def node_fields(nodes: DataFrame) -> DataFrame:
    """``record_id, node_kind, node_path, field, value`` of every scalar field of ``shred(..., fields=True)``."""
    return nodes.select("record_id", "node_kind", "node_path", F.explode("scalars").alias("field", "value"))


def flat_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """One table for each schema path of ``shred(..., fields=True)``: its links, key and ordinal, and a column for each field found.

    Fields are as many as the records have different keys, whatever the number of records; objects and arrays that are
    no tables of their own stay JSON texts.
    """
    named = nodes.select("node_kind", F.explode(F.array_distinct(F.concat(F.map_keys("scalars"), F.map_keys("nested")))).alias("field")).distinct()
    found: dict[str, list[str]] = {kind: [] for kind in KIND_OF_SCHEMA_PATH.values()}
    for r in named.collect():
        found[r.node_kind].append(r.field)
    links = ("record_id", "node_path", "parent_path", "node_key", "ordinal")
    return {
        kind: nodes.filter(F.col("node_kind") == kind).select(
            "record_id",
            "node_path",
            "parent_path",
            "node_key",
            F.element_at("dewey", -1).alias("ordinal"),
            *[F.coalesce(F.try_element_at("scalars", F.lit(f)), F.try_element_at("nested", F.lit(f))).alias(f if f not in links else f"field_{f}") for f in sorted(fields)],
        )
        for kind, fields in found.items()
    }
