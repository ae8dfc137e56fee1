"""Chat formatting: schema fingerprints choose how a record becomes canonical turns.

A record layout is recognised by the hash of those of its nested field paths that any
mapping names; further fields are metadata and do not count. Each known
fingerprint selects a declarative mapping (which path holds the list of turns, or
which fields are which turn), so records of many layouts end as the same array of
``(role, text)``. Only built-in expressions are used.

Defined cases: a null text or role is the empty string; rows of equal turn number
are ordered by role, then text; a null turn number comes last; a record of an
unknown layout, or JSON that cannot be parsed, has layout null and no turns; an
empty table gives no rows. Other columns are never read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.llm.common import free_name

TURNS = "array<struct<role:string,text:string>>"

#: Role names of common layouts and the canonical name of each.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


@dataclass(frozen=True, eq=False)
class Mapping:
    """How one layout becomes turns: a list field with role and text, or single fields."""

    name: str
    paths: tuple[str, ...]
    listed: tuple[str, str, str] | None = None
    single: tuple[tuple[str, str], ...] = ()
    rename: dict[str, str] = field(default_factory=dict, hash=False)


MAPPINGS = (
    Mapping("turn_rows", ("turns[].role", "turns[].text", "turns[].turn"), ("turns", "role", "text")),
    Mapping("messages", ("messages[].content", "messages[].role"), ("messages", "role", "content")),
    Mapping(
        "from_value", ("conversations[].from", "conversations[].value"), ("conversations", "from", "value"),
        rename=ROLE_NAMES,
    ),
    Mapping("instruction", ("instruction", "output"), single=(("user", "instruction"), ("assistant", "output"))),
    Mapping(
        "instruction_input", ("input", "instruction", "output"),
        single=(("user", "instruction"), ("user", "input"), ("assistant", "output")),
    ),
    Mapping(
        "instruction_system", ("input", "instruction", "output", "system"),
        single=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")),
    ),
    Mapping("prompt_completion", ("completion", "prompt"), single=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", ("prompt", "response"), single=(("user", "prompt"), ("assistant", "response"))),
    Mapping("question_answer", ("answer", "question"), single=(("user", "question"), ("assistant", "answer"))),
)


# --- fingerprints --------------------------------------------------------------------


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a Spark type, lists marked by ``[]``."""
    if isinstance(kind, T.StructType):
        dot = f"{prefix}." if prefix else ""
        return [p for f in kind.fields for p in field_paths(f.dataType, dot + f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def _fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(paths)), ","))


def _known(paths: Sequence[str]) -> Column:
    return _fingerprint(F.array(*[F.lit(p) for p in paths]))


#: Paths that any mapping names; all others are metadata and do not count.
NAMED = sorted({p for m in MAPPINGS for p in m.paths})


def json_fingerprint(payload: Column) -> Column:
    """Hash of the named field paths of each JSON record; null if it is not a JSON object."""
    lists: dict[str, list[str]] = {}
    for p in NAMED:
        if "[]." in p:
            lists.setdefault(p.split("[].")[0], []).append(p.split("[].")[1])
    plain = [F.lit(p) for p in NAMED if "[]" not in p]
    found = [F.array_intersect(F.json_object_keys(payload), F.array(*plain))]
    for head, tails in lists.items():
        items = F.from_json(F.get_json_object(payload, f"$.{head}"), "array<map<string,string>>")
        keys = F.flatten(F.transform(items, lambda item: F.coalesce(F.map_keys(item), F.array())))
        own = F.array_intersect(keys, F.array(*[F.lit(t) for t in tails]))
        found.append(F.coalesce(F.transform(own, lambda t: F.concat(F.lit(f"{head}[]."), t)), F.array()))  # noqa: B023
    return _fingerprint(F.concat(*found))


def _column_turns(record: Column, m: Mapping) -> Column:
    """Turns of a typed record by a mapping."""
    if m.listed:
        path, role, text = m.listed
        rows = record[path]
        if m.name == "turn_rows":
            rows = F.array_sort(
                F.transform(
                    rows,
                    lambda t: F.struct(
                        t["turn"].isNull().alias("last"), t["turn"].alias("turn"),
                        F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"),
                    ),
                )
            )
        names = F.create_map(*[F.lit(x) for pair in m.rename.items() for x in pair]) if m.rename else None
        return F.transform(
            rows,
            lambda t: F.struct(
                F.coalesce(*([names[F.coalesce(t[role], F.lit(""))]] if names is not None else []), t[role], F.lit("")).alias("role"),
                F.coalesce(t[text], F.lit("")).alias("text"),
            ),
        )
    turns = [F.struct(F.lit(r).alias("role"), F.coalesce(record[p], F.lit("")).alias("text")) for r, p in m.single]
    # an empty system field makes no turn
    return F.filter(F.array(*turns), lambda t: (t["text"] != "") | (t["role"] != "system"))


def _json_turns(payload: Column, m: Mapping) -> Column:
    if m.listed:
        path, role, text = m.listed
        extra = ",turn:bigint" if m.name == "turn_rows" else ""
        schema = f"struct<{path}:array<struct<{role}:string,{text}:string{extra}>>>"
    else:
        schema = "struct<" + ",".join(f"{p}:string" for _, p in m.single) + ">"
    return _column_turns(F.from_json(payload, schema), m).cast(TURNS)


def canonical_turns(df: DataFrame, payload: str) -> DataFrame:
    """Adds ``layout`` and ``turns``.

    A JSON column is fingerprinted row by row, so one table may mix layouts. A typed
    (struct) column has one set of paths, whose fingerprint is taken from its schema.
    """
    kind = df.schema[payload].dataType
    record = F.col(payload)
    if isinstance(kind, T.StructType):
        mine = [p for p in field_paths(kind) if p in NAMED]
        prints = _known(mine)
        fitting = {m: _column_turns(record, m) for m in MAPPINGS if set(m.paths) <= set(mine)}
    else:
        prints = json_fingerprint(record)
        fitting = {m: _json_turns(record, m) for m in MAPPINGS}
    layout = free_name("_layout", df.columns)
    chosen = [F.when(prints == _known(m.paths), m.name) for m in fitting]
    turns = [F.when(F.col(layout) == m.name, made.cast(TURNS)) for m, made in fitting.items()]
    return (
        df.withColumn(layout, F.coalesce(*chosen, F.lit(None).cast("string")))
        .withColumn("turns", F.coalesce(*turns, F.lit(None).cast(TURNS)))
        .withColumn("layout", F.col(layout))
        .drop(layout)
    )


# --- template ------------------------------------------------------------------------

OPEN, MID, CLOSE = "### ", ":\n", "</turn>\n"
#: Control strings and their escapes; a backslash is doubled before any of them.
ESCAPES = (("###", "\\h"), ("</turn>", "\\t"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"), ("\n", "\\n"))


def escape(text: Column, pairs: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, code in pairs:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    """Undo ``escape``: split at doubled backslashes, decode between them, join by one."""
    def part(p: Column) -> Column:
        for plain, code in ROLE_ESCAPES:
            p = F.replace(p, F.lit(code), F.lit(plain))
        return p

    return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")


def format_turns(df: DataFrame, turns: str = "turns", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Adds ``formatted`` and ``loss_spans``.

    A turn is written ``### role:`` newline, escaped text, ``</turn>`` newline. A loss
    span is (turn, start, length) in code points, start counted inside that turn, so
    reading a span never walks the whole conversation.
    """
    pieces = F.transform(
        F.col(turns),
        lambda t: F.struct(
            F.concat(F.lit(OPEN), escape(t["role"], ROLE_ESCAPES), F.lit(MID)).alias("head"),
            escape(t["text"]).alias("body"),
            t["role"].isin(*learn).alias("learn"),
        ),
    )
    spans = F.filter(
        F.transform(
            F.col("_pieces"),
            lambda p, i: F.struct(
                i.alias("turn"), F.length(p["head"]).alias("start"), F.length(p["body"]).alias("length"),
                p["learn"].alias("learn"),
            ),
        ),
        lambda s: s["learn"],
    )
    return (
        df.withColumn("_pieces", pieces)
        .withColumn("formatted", F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), ""))
        .withColumn("loss_spans", F.transform(spans, lambda s: F.struct(s["turn"], s["start"], s["length"])))
        .drop("_pieces")
    )


def read_back(df: DataFrame) -> DataFrame:
    """Adds ``read_turns`` and ``loss_text``, parsed from ``formatted`` and ``loss_spans`` alone."""
    raw = F.slice(F.split("formatted", CLOSE), 1, F.size(F.split("formatted", CLOSE)) - 1)
    cut = len(OPEN)
    return (
        df.withColumn("_raw", raw)
        .withColumn(
            "read_turns",
            F.transform(
                "_raw",
                lambda t: F.struct(
                    unescape(F.substring(F.substring_index(t, MID, 1), cut + 1, 1 << 30)).alias("role"),
                    unescape(F.substring(t, F.length(F.substring_index(t, MID, 1)) + len(MID) + 1, F.lit(1 << 30))).alias("text"),
                ),
            ),
        )
        .withColumn(
            "loss_text",
            F.array_join(
                F.transform("loss_spans", lambda s: unescape(F.substring(F.get("_raw", s["turn"]), s["start"] + 1, s["length"]))),
                "",
            ),
        )
        .drop("_raw")
    )


def turn_records(rows: DataFrame) -> DataFrame:
    """Rows by turn to one typed record for each conversation."""
    turn = F.struct(
        F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.groupBy("conv_id").agg(F.struct(F.collect_list(turn).alias("turns")).alias("record"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, layout, turns, formatted, loss_spans) of a table with one row for each turn."""
    return format_turns(canonical_turns(turn_records(rows.select("conv_id", "turn", "role", "text")), "record")).drop("record")


# --- query ---------------------------------------------------------------------------

PROBE_ID, PROBE = -7, "\\### Assistant: </turn> ok"


def query(spark, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    read = read_back(format_conversations(rows.unionByName(probe)))
    said = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("read_turns").cast("bigint").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *,
    length(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t')) AS body,
    length(replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ':', '\c'), chr(10), '\n')) AS head
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(4 + head + 2 + body + 8)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
