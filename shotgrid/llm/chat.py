r"""Operator 2: chat formatting by schema fingerprints (DataFrame functions only).

A layout is known by the hash of its nested field paths.  The fingerprint of a record selects
a declarative mapping into canonical turns (id, ord, role, text):

* typed frames are fingerprinted from their schema (`canonical_turns`);
* a column of JSON text may mix layouts row by row: each row is parsed to a variant, the
  hash of its own nested paths picks the mapping (`canonical_turns_json`).

Turns become one training text per conversation:

    <s>role\n[INST] text [/INST]</s>      every role but the assistant's
    <s>assistant\ntext</s>                under the loss mask

Control strings inside a text get one backslash after their first character (``<\s>``), and so
do strings that already look escaped, so that reading back removes exactly one.

Defined cases: null text or role counts as empty; a null id is a conversation of its own;
turns with equal order keep a fixed order by role and text, and repeated rows stay repeated
turns; a conversation without an assistant has an empty loss text; JSON rows of no known
layout (null, broken or strange) come out with layout ``unknown`` and no turns; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Control strings of the template.
BOS, EOS, INST, INST_END = "<s>", "</s>", "[INST] ", " [/INST]"
ASSISTANT = "assistant"

ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: layout -> (nested field paths, how its turns are found).  ("list", array, role, text): one
#: turn per element; ("pairs", [(role, [paths])]): one turn per entry, its non-empty parts
#: joined by a blank line; ("row", order, role, text): every record is one turn.
LAYOUTS: dict[str, tuple[list[str], tuple]] = {
    "turn_rows": (["role", "text", "turn"], ("row", "turn", "role", "text")),
    "messages": (["messages[].content", "messages[].role"], ("list", "messages", "role", "content")),
    "from_value": (["conversations[].from", "conversations[].value"], ("list", "conversations", "from", "value")),
    "instruction": (["instruction", "output"], ("pairs", [("user", ["instruction"]), ("assistant", ["output"])])),
    "instruction_input": (["input", "instruction", "output"],
                          ("pairs", [("user", ["instruction", "input"]), ("assistant", ["output"])])),
    "system_instruction": (["instruction", "output", "system"],
                           ("pairs", [("system", ["system"]), ("user", ["instruction"]), ("assistant", ["output"])])),
    "prompt_completion": (["completion", "prompt"], ("pairs", [("user", ["prompt"]), ("assistant", ["completion"])])),
    "prompt_response": (["prompt", "response"], ("pairs", [("user", ["prompt"]), ("assistant", ["response"])])),
}


# ------------------------------------------------------------------------- fingerprints
def shape(paths: list[str]) -> str:
    """Nested field paths as one canonical string, as ``schema_of_variant`` would nest them."""
    tree: dict = {}
    for p in paths:
        at = tree
        steps = p.split(".")
        for s in steps[:-1]:
            at = at.setdefault(s, {})
        at.setdefault(steps[-1], None)

    def show(node: dict | None) -> str:
        if node is None:
            return "_"
        parts = []
        for k in sorted(node):
            inner = show(node[k])
            parts.append(f"{k[:-2]}: ARRAY<{inner}>" if k.endswith("[]") else f"{k}: {inner}")
        return f"OBJECT<{', '.join(parts)}>"

    return show(tree)


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256(shape(paths).encode()).hexdigest()[:16]


FINGERPRINTS = {fingerprint(paths): name for name, (paths, _) in LAYOUTS.items()}


def schema_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    out = []
    for f in schema.fields:
        kind, name = f.dataType, prefix + f.name
        while isinstance(kind, T.ArrayType):
            kind, name = kind.elementType, name + "[]"
        out += schema_paths(kind, name + ".") if isinstance(kind, T.StructType) else [name]
    return out


def variant_fingerprint(v: Column) -> Column:
    """Per row: hash of the nested field paths of a variant, scalar types left out."""
    kinds = F.regexp_replace(F.schema_of_variant(v), r"(: |ARRAY<)(?!OBJECT<|ARRAY<)[A-Z]+(\([0-9, ]+\))?", "$1_")
    return F.substring(F.sha2(kinds, 256), 1, 16)


# ---------------------------------------------------------------------- canonical turns
def _role(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv])
    return F.coalesce(F.element_at(names, c), c)


def _pairs(entries: list, part) -> Column:
    turns = [F.struct(F.lit(i).cast("long").alias("ord"), F.lit(role).alias("role"),
                      F.array_join(F.filter(F.array(*[part(p) for p in paths]), lambda x: x != ""), "\n\n").alias("text"))
             for i, (role, paths) in enumerate(entries)]
    return F.filter(F.array(*turns), lambda t: (t["role"] != "system") | (t["text"] != ""))


def _listed(items: Column, role: str, text: str) -> Column:
    return F.transform(items, lambda m, i: F.struct(
        i.cast("long").alias("ord"), _role(m[role]).alias("role"), m[text].alias("text")))


def canonical_turns(df: DataFrame, id_col: str) -> DataFrame:
    """(id, ord, role, text) of a typed frame; its schema's fingerprint selects the mapping."""
    paths = [p for p in schema_paths(df.schema) if p != id_col]
    name = FINGERPRINTS.get(fingerprint(paths))
    if name is None:
        raise ValueError(f"no layout has the field paths {sorted(paths)}")
    how = LAYOUTS[name][1]
    if how[0] == "row":
        return df.select(F.col(id_col).alias("id"), F.col(how[1]).cast("long").alias("ord"),
                         F.col(how[2]).alias("role"), F.col(how[3]).alias("text"))
    if how[0] == "list":
        turns = _listed(F.col(how[1]), how[2], how[3])
    else:
        turns = _pairs(how[1], lambda p: F.coalesce(F.col(p), F.lit("")))
    return df.select(F.col(id_col).alias("id"), F.inline(turns))


def canonical_turns_json(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, layout, ord, role, text) of records kept as JSON text in any mix of layouts."""
    d = df.select(F.col(id_col).alias("id"), F.try_parse_json(json_col).alias("v"))
    finger = variant_fingerprint(F.col("v"))
    names = F.create_map(*[F.lit(x) for kv in FINGERPRINTS.items() for x in kv])
    d = d.withColumn("layout", F.coalesce(F.element_at(names, finger), F.lit("unknown")))
    kind = "array<struct<ord:bigint,role:string,text:string>>"
    turns = F.lit(None).cast(kind)
    for name, (_, how) in LAYOUTS.items():
        if how[0] == "row":
            one = F.array(F.struct(F.try_variant_get("v", f"$.{how[1]}", "bigint").alias("ord"),
                                   _role(F.try_variant_get("v", f"$.{how[2]}", "string")).alias("role"),
                                   F.try_variant_get("v", f"$.{how[3]}", "string").alias("text")))
        elif how[0] == "list":
            rows = F.try_variant_get("v", f"$.{how[1]}", f"array<struct<`{how[2]}`:string,`{how[3]}`:string>>")
            one = _listed(rows, how[2], how[3])
        else:
            one = _pairs(how[1], lambda p: F.coalesce(F.try_variant_get("v", f"$.{p}", "string"), F.lit("")))
        turns = F.when(F.col("layout") == name, one.cast(kind)).otherwise(turns)
    return d.select("id", "layout", F.inline_outer(turns))


# -------------------------------------------------------------------------- format, parse
def escape(c: Column) -> Column:
    c = F.regexp_replace(c, r"<(\\*)(/?s)>", r"<\\$1$2>")
    return F.regexp_replace(c, r"\[(\\*)(/?INST)\]", r"[\\$1$2]")


def unescape(c: Column) -> Column:
    c = F.regexp_replace(c, r"<\\(\\*)(/?s)>", r"<$1$2>")
    return F.regexp_replace(c, r"\[\\(\\*)(/?INST)\]", r"[$1$2]")


def _role_out(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def _role_in(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_turns(turns: DataFrame) -> DataFrame:
    """id, formatted, loss_spans (start, end in code points of ``formatted``).  Offsets are
    running sums per conversation, so a long conversation costs no more per turn."""
    t = turns.select("id", "ord", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    learn = F.col("role") == ASSISTANT
    head = F.concat(F.lit(BOS), _role_out(F.col("role")), F.lit("\n"), F.when(learn, "").otherwise(INST))
    tail = F.concat(F.when(learn, "").otherwise(INST_END), F.lit(EOS))
    t = t.withColumn("learn", learn).withColumn("head", head).withColumn("body", escape(F.col("text"))) \
         .withColumn("piece", F.concat("head", "body", tail))
    w = Window.partitionBy("id").orderBy("ord", "role", "text")
    before = F.coalesce(F.sum(F.length("piece").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("n", F.row_number().over(w)).withColumn("start", before + F.length("head"))
    t = t.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(
        "n", "piece", "learn", "start", (F.col("start") + F.length("body")).alias("end")))).alias("p"))
    return t.select("id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"),
                    F.transform(F.filter("p", lambda x: x["learn"]), lambda x: F.struct(x["start"], x["end"])).alias("loss_spans"))


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    def turn(p):
        body = F.substr(p, F.lit(len(BOS) + 1))
        nl = F.instr(body, "\n")
        role = F.substring(body, F.lit(1), nl - 1)
        rest = F.substr(body, nl + 1)
        inner = F.substring(rest, F.lit(len(INST) + 1), F.length(rest) - len(INST) - len(INST_END))
        return F.struct(_role_in(role).alias("role"), unescape(F.when(role == ASSISTANT, rest).otherwise(inner)).alias("text"))

    parts = F.split(formatted, EOS)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    out = format_turns(canonical_turns(rows.unionByName(more), "conv_id"))
    out = out.withColumn("turns", parse_turns(F.col("formatted"))) \
             .withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(regexp_replace(text, '<(\\*)(/?s)>', '<\\\1\2>', 'g'),
                           '\[(\\*)(/?INST)\]', '[\\\1\2]', 'g') AS body,
         replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C') AS name FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(8 + length(name) + length(body) + CASE WHEN role = 'assistant' THEN 0 ELSE 15 END) AS BIGINT)
         AS formatted_chars
FROM e GROUP BY conv_id"""

QUERIES = {"op2_chat_format": op2_chat_format}
SQL = {"op2_chat_format": _SQL}
