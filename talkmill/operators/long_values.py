"""Conversations too long for Spark's typed JSON values, read from their raw text in the tasks.

Typed values and single strings of JSON have a size limit in Spark. Values of more than ``LONG`` bytes, a handful in
any collection, go to Python in Arrow batches; all others are null there and stay with Spark's functions. Their text is put together by
the same rules as in ``extract``, except that a repeated key gives its last value instead of a rejected row.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes up to which a value is read by Spark's own functions.
LONG = 16_000_000


def is_long(value: Column) -> Column:
    return F.octet_length(value) > LONG


def only_long(value: Column) -> Column:
    return F.when(is_long(value), value)


def _items_of(raw: str) -> list[dict] | None:
    """The items of a JSON list, each as its raw text, without keeping what they hold."""
    decoder, white = json.JSONDecoder(), re.compile(r"[ \t\r\n]*")

    def skip(at: int) -> int:
        return white.match(raw, at).end()

    at, out = skip(0), []
    if raw[at : at + 1] != "[":
        return None
    at = skip(at + 1)
    try:
        if raw[at : at + 1] == "]":
            return [] if skip(at + 1) == len(raw) else None
        while True:
            value, end = decoder.raw_decode(raw, at)
            text = value if isinstance(value, str) else None if value is None else raw[at:end]
            out.append({"raw": text, "is_object": isinstance(value, dict)})
            at = skip(end)
            if raw[at : at + 1] == "]":
                return out if skip(at + 1) == len(raw) else None
            if raw[at : at + 1] != ",":
                return None
            at = skip(at + 1)
    except (ValueError, RecursionError):
        return None


def _reader(rules: dict):
    """A function from the raw text of one conversation to its text or the reason it has none, and its names."""
    white, fields = rules["white"], rules["fields"]

    class Rejected(Exception):
        pass

    def fragment(value) -> list[str]:
        if not value:
            return []
        if not isinstance(value, str):
            raise Rejected(rules["bad_text"])
        return [value.strip(white)]

    def plain(value: str) -> list[str]:
        return [value.strip(white)] if value.strip(white) else []

    def of_list(messages) -> list[str]:
        if messages in ("", {}):
            return []
        if not isinstance(messages, list) or not all(m is None or isinstance(m, dict) for m in messages):
            raise Rejected(rules["bad_messages"])
        out = []
        for message in filter(None, messages):
            if message.get("text"):
                out += fragment(message["text"])
                continue
            content = message.get("content")
            for item in content if isinstance(content, list) else []:
                out += fragment(item.get("text")) if isinstance(item, dict) else plain(item) if isinstance(item, str) else []
        return out

    def parts_of(message) -> list:
        if not isinstance(message, dict):
            if message:
                raise Rejected(rules["bad_message"])
            return []
        content = message.get("content")
        parts = content.get("parts", []) if isinstance(content, dict) else []
        if not isinstance(parts, list) and parts not in ("", {}, "{}"):
            raise Rejected(rules["bad_parts"])
        return parts if isinstance(parts, list) else []

    def of_map(nodes) -> list[str]:
        if not isinstance(nodes, dict) or not all(isinstance(n, dict) for n in nodes.values()):
            raise Rejected(rules["bad_mapping"])
        out = []
        for part in [p for n in nodes.values() for p in parts_of(n.get("message"))]:
            if isinstance(part, str):
                out += plain(part)
            elif isinstance(part, dict) and part.get("content_type") == rules["audio"]:
                out += fragment(part.get("text"))
        return out

    def search(value, depth: int) -> str:
        if depth >= rules["depth"] or not isinstance(value, (dict, list)):
            return ""
        found = []
        if isinstance(value, dict):
            found = [value[f].strip(white) for f in fields if isinstance(value.get(f), str) and value[f].strip(white)]
            below = list(value.values())[: rules["values"]]
        else:
            below = value[: rules["items"]]
        for member in below:
            text = search(member, depth + 1)
            if text and len(found) <= rules["stop"]:
                found.append(text)
        return " ".join(found)

    def read(raw: str) -> dict:
        out = dict.fromkeys(["text", "reject", "uuid", "title", "id"]) | {"names": []}
        try:
            value = json.loads(raw)
        except (ValueError, RecursionError):
            value = None
        if not isinstance(value, dict):
            return out | {"reject": rules["not_an_object"]}
        for name in ("uuid", "title", "id"):
            if name in value:
                given = value[name]
                out["names"].append(name)
                out[name] = given if given is None or isinstance(given, str) else json.dumps(given, ensure_ascii=False, separators=(",", ":"))
        try:
            if rules["list_key"] in value:
                out["text"] = " ".join(of_list(value[rules["list_key"]]))
            elif rules["map_key"] in value:
                out["text"] = " ".join(of_map(value[rules["map_key"]]))
            else:
                out["text"] = search(value, 0)
        except Rejected as reason:
            out["reject"] = str(reason)
        return out

    return read


_READ = "struct<text:string,reject:string,uuid:string,title:string,id:string,names:array<string>>"


def long_items(value: Column) -> Column:
    """Items of a long JSON list as ``(raw, is_object)``; null for one that is no list, or not long."""

    def items(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _items_of(t) for t in texts], dtype=object)

    return F.pandas_udf(items, "array<struct<raw:string,is_object:boolean>>")(only_long(value))


def long_conversation(value: Column, rules: dict) -> Column:
    """``text, reject, uuid, title, id, names`` of a long conversation; null of one that is not long."""

    def conversations(texts: pd.Series) -> pd.DataFrame:
        read = _reader(rules)
        rows = [dict.fromkeys(["text", "reject", "uuid", "title", "id", "names"]) if t is None else read(t) for t in texts]
        return pd.DataFrame(rows, columns=["text", "reject", "uuid", "title", "id", "names"], dtype=object)

    return F.pandas_udf(conversations, _READ)(only_long(value))
