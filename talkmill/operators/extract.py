"""Flattening exported conversations: raw JSON of one conversation to one text.

Three shapes are told apart by their keys: a message list (``chat_messages``), a
node map (``mapping``) and anything else, which is searched to a small depth.

``VARIANT`` tells strings from objects, which ``array<string>`` cannot, but sorts
object keys.  So it is used only below the level whose order matters, and where
both order and type matter, raw text and ``VARIANT`` are read side by side.

Rows that cannot be flattened get a reason in ``reject`` instead of ending their
whole file.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions import text as T
from talkmill.functions.once import let, with_once
from talkmill.operators.long_values import is_long, long_conversation

# Search fields and bounds of the search in unknown shapes.
SEARCH_FIELDS = ["text", "content", "message"]
MAX_DEPTH, MAX_VALUES, MAX_ITEMS, STOP_AFTER = 3, 10, 20, 5

# Key names of the two known shapes.
LIST_KEY, MAP_KEY = "chat_messages", "mapping"
AUDIO_PART = "audio_transcription"

NOT_AN_OBJECT = "not_an_object"
BAD_MESSAGES = "bad_messages"
BAD_MAPPING = "bad_mapping"
BAD_TEXT = "text_not_a_string"
BAD_MESSAGE = "message_not_an_object"
BAD_PARTS = "parts_not_a_list"
UNREADABLE = "unreadable_value"

#: The rules for conversations too long for Spark's typed values.
RULES = {
    "white": T.WHITESPACE,
    "fields": SEARCH_FIELDS,
    "list_key": LIST_KEY,
    "map_key": MAP_KEY,
    "audio": AUDIO_PART,
    "depth": MAX_DEPTH,
    "values": MAX_VALUES,
    "items": MAX_ITEMS,
    "stop": STOP_AFTER,
    "not_an_object": NOT_AN_OBJECT,
    "bad_messages": BAD_MESSAGES,
    "bad_mapping": BAD_MAPPING,
    "bad_text": BAD_TEXT,
    "bad_message": BAD_MESSAGE,
    "bad_parts": BAD_PARTS,
}

_NONE = "cast(array() as array<string>)"


def _no_text() -> Column:
    return F.lit(None).cast("string")


def _map(v: Column) -> Column:
    """Entries of an object; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _items(v: Column) -> Column:
    """Items of a list; null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def _string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _child(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _kind(v: Column) -> Column:
    """``object, list, string, scalar``, or null for an absent or null value.

    The schema of a value describes everything below it, so it is only taken of
    values without anything below.
    """
    return (
        F.when(_map(v).isNotNull(), "object")
        .when(_items(v).isNotNull(), "list")
        .when(v.isNotNull() & ~F.is_variant_null(v), _scalar_kind(v))
    )


def _scalar_kind(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", "string").otherwise("scalar")


def _by_kind(v: Column, body: Callable[[Column, Column], Column]) -> Column:
    typed = let(v, lambda x: F.struct(x.alias("v"), _kind(x).alias("kind")))
    return let(typed, lambda t: body(t["v"], t["kind"]))


def _is_falsy(v: Column, kind: Column) -> Column:
    """Absent, null, false, zero, or empty."""
    zero = F.coalesce(_string(v).try_cast("double") == 0, F.lit(False))
    return (
        F.when(kind.isNull(), True)
        .when(kind == "string", _string(v) == "")
        .when(kind == "object", F.size(_map(v)) == 0)
        .when(kind == "list", F.size(_items(v)) == 0)
        .otherwise((_string(v) == "false") | zero)
    )


def _texts(*found: Column) -> Column:
    texts = F.array(*found) if found else F.expr(_NONE)
    return F.struct(texts.alias("texts"), F.lit(False).alias("bad"))


def _fragment(v: Column, otherwise: Column) -> Column:
    """A truthy ``text`` as ``(texts, bad)``: stripped if a string, bad if not."""
    bad = F.struct(F.expr(_NONE).alias("texts"), F.lit(True).alias("bad"))

    def body(v: Column, kind: Column) -> Column:
        string = _texts(T.strip(_string(v)))
        return F.when(_is_falsy(v, kind), otherwise).when(kind == "string", string).otherwise(bad)

    return _by_kind(v, body)


def _plain_string(v: Column) -> Column:
    """The text of a string item, unless blank."""
    return let(
        T.strip(_string(v)), lambda s: F.when(s != "", _texts(s)).otherwise(_texts())
    )


def _gather(parts: Column) -> Column:
    """Put together the ``(texts, bad)`` of several parts."""
    return F.struct(
        F.flatten(F.transform(parts, lambda p: p["texts"])).alias("texts"),
        F.exists(parts, lambda p: p["bad"]).alias("bad"),
    )


def _gather_items(items: Column, of_item: Callable[[Column, Column], Column]) -> Column:
    """Gather over the items of a list; anything else has none."""
    gathered = let(
        F.transform(items, lambda x: _by_kind(x, of_item)), _gather
    )
    return F.when(items.isNull(), _texts()).otherwise(gathered)


def _result(text: Column, reject: Column | None = None) -> Column:
    return F.struct(
        text.alias("text"), (_no_text() if reject is None else reject).alias("reject")
    )


def _rejected(reason: str) -> Column:
    return _result(_no_text(), F.lit(reason))


def _joined(gathered: Column) -> Column:
    return F.when(gathered["bad"], _rejected(BAD_TEXT)).otherwise(
        _result(F.array_join(gathered["texts"], " "))
    )


def _lost(typed: Column, raw: Column, fields: list[str]) -> Column:
    """True where a value is present in the JSON but could not be read as ``VARIANT``."""
    pairs = F.arrays_zip(typed.alias("typed"), raw.alias("raw"))

    def lost(p: Column) -> Column:
        tests = [p["typed"][f].isNull() & p["raw"][f].isNotNull() for f in fields]
        return tests[0] if len(tests) == 1 else tests[0] | tests[1]

    return F.coalesce(F.exists(pairs, lost), F.lit(False))


def _last_of_each(entries: Column) -> Column:
    """Entries with a repeated key kept once: its last value at its first place."""

    def of_keys(keys: Column) -> Column:
        def last(k: Column) -> Column:
            return F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)

        once = F.transform(F.array_distinct(keys), last)
        repeated = F.size(F.array_distinct(keys)) < F.size(keys)
        return F.when(repeated, once).otherwise(entries)

    return let(F.transform(entries, lambda e: e["key"]), of_keys)


def from_message_list(j: Column) -> Column:
    """``(text, reject)`` of a conversation with a message list."""

    def of_item(item: Column, kind: Column) -> Column:
        return (
            F.when(kind == "object", _fragment(_child(item, "text"), _texts()))
            .when(kind == "string", _plain_string(item))
            .otherwise(_texts())
        )

    def of_message(m: Column) -> Column:
        content = let(_items(m["content"]), lambda items: _gather_items(items, of_item))
        return _fragment(m["text"], content)

    typed_schema = f"struct<{LIST_KEY}:array<struct<text:variant,content:variant>>>"
    raw_schema = f"struct<{LIST_KEY}:array<struct<text:string,content:string>>>"
    raw = F.from_json(j, raw_schema)[LIST_KEY]

    def of_messages(messages: Column) -> Column:
        no_iteration = F.get_json_object(j, f"$.{LIST_KEY}").isin("", "{}")
        suspicious = F.exists(messages, lambda m: m["text"].isNull() & m["content"].isNull())
        return (
            F.when(
                messages.isNull(),
                F.when(no_iteration, _result(F.lit(""))).otherwise(_rejected(BAD_MESSAGES)),
            )
            .when(suspicious & _lost(messages, raw, ["text", "content"]), _rejected(UNREADABLE))
            .otherwise(let(let(F.transform(messages, of_message), _gather), _joined))
        )

    return let(F.from_json(j, typed_schema)[LIST_KEY], of_messages)


def from_node_map(j: Column) -> Column:
    """``(text, reject)`` of a conversation with a node map, in document order."""

    def of_part(part: Column, kind: Column) -> Column:
        audio = _string(_child(part, "content_type")) == AUDIO_PART
        spoken = F.when(audio, _fragment(_child(part, "text"), _texts())).otherwise(_texts())
        return (
            F.when(kind == "object", spoken)
            .when(kind == "string", _plain_string(part))
            .otherwise(_texts())
        )

    typed = F.from_json(j, f"struct<{MAP_KEY}:map<string,struct<message:variant>>>")[MAP_KEY]
    raw = F.from_json(j, f"struct<{MAP_KEY}:map<string,struct<message:string>>>")[MAP_KEY]
    raw = F.map_values(raw)

    def problem(m: Column, kind: Column) -> Column:
        """Reason a message cannot be read, if any."""
        parts = _child(_child(m, "content"), "parts")
        listed = _items(parts).isNotNull() | F.coalesce(
            _string(parts).isin("", "{}"), F.lit(False)
        )
        return F.when(kind == "object", F.when(parts.isNotNull() & ~listed, BAD_PARTS)).when(
            ~_is_falsy(m, kind), BAD_MESSAGE
        )

    def of_message(m: Column) -> Column:
        """``(parts, problem)``: a list, or null where there is none."""
        return _by_kind(
            m,
            lambda m, kind: F.struct(
                _items(_child(_child(m, "content"), "parts")).alias("parts"),
                problem(m, kind).alias("problem"),
            ),
        )

    def of_entries(entries: Column) -> Column:
        nodes = F.transform(entries, lambda e: e["value"])
        last = F.transform(_last_of_each(entries), lambda e: e["value"])

        def of_nodes(nodes: Column) -> Column:
            suspicious = F.exists(nodes, lambda n: n["message"].isNull())
            read = F.transform(last, lambda n: of_message(n["message"]))
            return (
                F.when(F.exists(nodes, lambda n: n.isNull()), _rejected(BAD_MAPPING))
                .when(suspicious & _lost(nodes, raw, ["message"]), _rejected(UNREADABLE))
                .otherwise(let(read, of_read))
            )

        def of_read(messages: Column) -> Column:
            problems = F.filter(
                F.transform(messages, lambda m: m["problem"]), lambda p: p.isNotNull()
            )
            parts = F.transform(messages, lambda m: _gather_items(m["parts"], of_part))
            first = _result(_no_text(), F.get(problems, F.lit(0)))
            return F.when(F.size(problems) > 0, first).otherwise(
                let(let(parts, _gather), _joined)
            )

        return (
            F.when(entries.isNull(), _rejected(BAD_MAPPING))
            .otherwise(let(nodes, of_nodes))
        )

    return let(F.map_entries(typed), of_entries)


def _tagged(keys: Column, raw: Column, typed: Column) -> Column:
    """``(key, raw, kind)`` of JSON values; ``raw`` keeps their document order below."""
    kinds = F.transform(typed, _kind)
    return F.arrays_zip(keys.alias("key"), raw.alias("raw"), kinds.alias("kind"))


def _object_entries(j: Column) -> Column:
    raw = F.from_json(j, "map<string,string>")
    typed = F.from_json(j, "map<string,variant>")
    tagged = _tagged(F.map_keys(raw), F.map_values(raw), F.map_values(typed))
    return let(tagged, _last_of_each)


def _list_entries(j: Column) -> Column:
    raw = F.from_json(j, "array<string>")
    return _tagged(
        F.transform(raw, lambda _: F.lit("")), raw, F.from_json(j, "array<variant>")
    )


def _own_texts(entries: Column) -> Column:
    def of_field(name: str) -> Column:
        own = F.filter(entries, lambda e: (e["key"] == name) & (e["kind"] == "string"))
        stripped = F.transform(own, lambda e: T.strip(e["raw"]))
        return F.filter(stripped, lambda s: s != "")

    return F.concat(*[of_field(f) for f in SEARCH_FIELDS])


def _add_until_full(found: Column, results: Column) -> Column:
    return F.aggregate(
        results,
        found,
        lambda acc, r: F.when((r != "") & (F.size(acc) <= STOP_AFTER), F.array_append(acc, r))
        .otherwise(acc),
    )


def _search(raw: Column, kind: Column, depth: int, max_depth: int) -> Column:
    """Text found in one JSON value; unrolled, as the depth is a small constant."""
    if depth >= max_depth:
        return F.lit("")
    none = F.expr(_NONE)

    def below(entries: Column, most: int) -> Column:
        if depth + 1 >= max_depth:
            return F.expr(_NONE)
        return F.transform(
            F.slice(entries, 1, most), lambda e: _search(e["raw"], e["kind"], depth + 1, max_depth)
        )

    def of_object(entries: Column) -> Column:
        found = _add_until_full(_own_texts(entries), below(entries, MAX_VALUES))
        return F.array_join(found, " ")

    def of_list(entries: Column) -> Column:
        return F.array_join(_add_until_full(none, below(entries, MAX_ITEMS)), " ")

    in_list = let(_list_entries(raw), of_list) if depth + 1 < max_depth else F.lit("")
    return (
        F.when(kind == "object", let(_object_entries(raw), of_object))
        .when(kind == "list", in_list)
        .otherwise("")
    )


def search_text(j: Column, max_depth: int = MAX_DEPTH) -> Column:
    """Text of a JSON object or list of unknown shape, searched to ``max_depth``.

    Null where the JSON has a duplicate key or another value that cannot be read.
    """
    is_list = F.startswith(F.ltrim(j), F.lit("["))
    kind = F.when(is_list, "list").when(F.json_object_keys(j).isNotNull(), "object")
    return _search(j, kind, 0, max_depth)


def from_unknown(j: Column) -> Column:
    return let(
        search_text(j),
        lambda s: F.when(s.isNull(), _rejected(UNREADABLE)).otherwise(_result(s)),
    )


def extract(name: str) -> Column:
    """``(text, reject)`` of the conversation in a column; a known shape never falls back.

    The expression is large and is put together once per session, call by call to
    the JVM, so it is kept.
    """
    return _extract(name, SparkContext.getOrCreate().applicationId)


@lru_cache(maxsize=16)
def _extract(name: str, application: str) -> Column:
    j = F.col(name)

    def of_keys(keys: Column) -> Column:
        return (
            F.when(keys.isNull(), _rejected(NOT_AN_OBJECT))
            .when(F.array_contains(keys, LIST_KEY), from_message_list(j))
            .when(F.array_contains(keys, MAP_KEY), from_node_map(j))
            .otherwise(from_unknown(j))
        )

    return let(F.json_object_keys(j), of_keys)


def _made_up_id(pos: Column, source_file: Column, variant: str) -> Column:
    if variant == "cli":
        return F.concat(F.lit("conv_"), pos.cast("string"), F.lit("_"), source_file)
    return F.concat(F.lit("conv_"), pos.cast("string"))


def _given_id(keys: Column, value: Callable[[str], Column], made_up: Column, variant: str) -> Column:
    names = ["uuid", "title"] if variant == "cli" else ["uuid", "title", "id"]
    pick = F.when(F.array_contains(keys, names[0]), value(names[0]))
    for name in names[1:]:
        pick = pick.when(F.array_contains(keys, name), value(name))
    return pick.otherwise(made_up)


def conversation_id(j: Column, pos: Column, source_file: Column, *, variant: str = "cli") -> Column:
    """Id of a conversation; ``pos`` counts all conversations of the file from 1.

    An explicit null counts as given.  The upload analysis also looks at ``id``,
    leaves the file out of the made-up id, and writes null as ``None``.
    """
    made_up = _made_up_id(pos, source_file, variant)

    def of_keys(keys: Column) -> Column:
        return _given_id(keys, lambda name: F.get_json_object(j, f"$.{name}"), made_up, variant)

    found = let(F.json_object_keys(j), of_keys)
    return found if variant == "cli" else F.coalesce(found, F.lit("None"))


def _long_id(pos: Column, source_file: Column, *, variant: str) -> Column:
    """As ``conversation_id``, from what was read of a long conversation."""
    found = _given_id(F.col("__long.names"), lambda name: F.col(f"__long.{name}"), _made_up_id(pos, source_file, variant), variant)
    return found if variant == "cli" else F.coalesce(found, F.lit("None"))


def with_text(
    conversations: DataFrame, *, variant: str = "cli", raw: str = "conversation"
) -> DataFrame:
    """Replace raw conversations by ``conversation_id, text, reject``."""
    j = F.col(raw)
    kept = [c for c in conversations.columns if c not in (raw, "reject")]
    given = F.col("reject") if "reject" in conversations.columns else _no_text()
    long = is_long(j) & given.isNull()
    seen = conversations.withColumn("__long", long_conversation(F.when(given.isNull(), j), RULES))
    extracted = (
        F.when(given.isNotNull(), _result(_no_text(), given))
        .when(long, _result(F.col("__long.text"), F.col("__long.reject")))
        .otherwise(extract(raw))
    )
    place = (F.col("pos"), F.col("source_file"))
    named = F.when(long, _long_id(*place, variant=variant)).otherwise(conversation_id(j, *place, variant=variant))
    rows = with_once(seen, {"conversation_id": named, "__extracted": extracted})
    return rows.select(
        "conversation_id",
        F.col("__extracted.text").alias("text"),
        *kept,
        F.col("__extracted.reject").alias("reject"),
    )


def non_blank(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows with any text."""
    return df.filter(~T.is_blank(text))
