"""Personal data by anchor expansion: one Aho-Corasick pass finds anchors, local parsers expand and validate them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that the anchors add, listed after the base ones.
KINDS = (*BASE_KINDS, "url", "account")
#: Identifier cues in lower case; they are anchors in any spelling of ASCII letters.
CUES = ("iban", "ssn", "account", "acct", "passport", "token", "secret", "password", "api_key", "apikey", "api key", "customer id", "user id", "licence", "license")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
# The parsers below only look from a given place onwards, each in one pass.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_CALL = re.compile(r"[\x20().0-9-]+")
_HOST = re.compile(r"(?:[^\s/?#@\"'<>]+@)?((?:[A-Za-z0-9-]+\.)+[A-Za-z0-9-]+|localhost|\[[0-9A-Fa-f:.]+\])(?::[0-9]{1,5})?(?:[/?#][^\s\"'<>]*)?")
_CUE_GAP = re.compile(r"(?:[ _-]?(?:number|no\.?|nr\.?|id|key))?[\"']?([ \t]*[:=#][ \t]*|[ \t]+)[\"']?", re.IGNORECASE)
_CODE = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]*")
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[ ]?[A-Za-z0-9]){11,30}")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for mark in ("@", "+", "://", *"0123456789"):
        found.add_word(mark, ("digit" if mark.isdigit() else mark, len(mark)))
    for cue in CUES:
        found.add_word(cue, (cue, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return sum(values[::2] + [d * 2 - 9 * (d > 4) for d in values[1::2]]) % 10 == 0


def _account(text: str, cue: str, start: int, end: int) -> tuple[int, int] | None:
    """The value after an identifier cue, if the cue stands alone and the value has the form that the cue asks for."""
    if start and text[start - 1] in _ALNUM:
        return None
    gap = _CUE_GAP.match(text, end)
    if not gap:
        return None
    at = gap.end()
    if cue == "iban":
        m = _IBAN.match(text, at)
        while m and m.end() - at >= 15:
            code = m[0].replace(" ", "").upper()
            for n in range(len(code), 14, -1):
                if int("".join(str(int(c, 36)) for c in code[4:n] + code[:4])) % 97 == 1:
                    width = next(i for i in range(len(m[0]) + 1) if len(m[0][:i].replace(" ", "")) == n)
                    if at + width == len(text) or text[at + width] not in _ALNUM:
                        return at, at + width
            return None
        return None
    if cue == "ssn":
        m = _SSN.match(text, at)
        return (at, m.end()) if m and m[0][:3] not in ("000", "666") and m[0][4:6] != "00" and m[0][7:] != "0000" else None
    if not gap[1].strip():
        return None
    m = _CODE.match(text, at)
    if m and m.end() - at >= 6 and sum(c.isdigit() for c in m[0]) >= 4:
        return at, m.end()
    return None


def spans(text: str, anchors: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Per kind, (start, end) in code points, by start. The base kinds hold exactly what their patterns match."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    ip_from = card_from = mail_from = 0
    lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z alone, so offsets stay
    for last, (what, length) in anchors.iter(lower):
        at = last - length + 1
        if what == "digit":
            if at >= ip_from:
                chain = _DOTTED.match(text, at)
                ip_from = chain.end()
                if ip_from - at >= 7 and chain[0].count(".") >= 3:
                    parts, begin = chain[0].split("."), at
                    for k in range(0, len(parts) - 3, 4):
                        end = begin + sum(map(len, parts[k : k + 4])) + 3
                        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[k : k + 4]):
                            found["ip"].append((begin, end))
                        begin = end + 1
            if at >= card_from:
                chain = _DIGITS.match(text, at)
                card_from = chain.end()
                if card_from - at >= 16:
                    digits = chain[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append((at, card_from))
        elif what == "@":
            begin = at
            while begin > mail_from and text[begin - 1] in _LOCAL:
                begin -= 1
            domain = _DOMAIN.match(text, at + 1) if begin < at else None
            mail_from = at + 1
            if domain:
                mail_from = domain.end()
                found["email"].append((begin, mail_from))
        elif what == "+":
            if text[at + 1 : at + 2] in tuple("0123456789"):
                run = _CALL.match(text, at + 2)
                if run:
                    body = run[0].rstrip(" ().-")
                    if len(body) >= 2 and 8 <= 1 + sum(c.isdigit() for c in body) <= 15:
                        found["phone"].append((at, at + 2 + len(body)))
        elif what == "://":
            begin = at
            while begin and text[begin - 1] in _ALNUM:
                begin -= 1
            host = _HOST.match(text, last + 1)
            if begin < at and not text[begin].isdigit() and host and (not found["url"] or begin >= found["url"][-1][1]):
                end = host.end()
                while text[end - 1] in ".,;:!?)":
                    end -= 1
                found["url"].append((begin, end))
        else:
            value = _account(text, what, at, last + 1)
            if value and (not found["account"] or value[0] >= found["account"][-1][1]):
                found["account"].append(value)
    return found


def listed(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = _automaton()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    for batch in batches:
        for first in range(0, batch.num_rows, 512):
            part = batch.slice(first, 512)
            rows = [spans(t or "", anchors) for t in part.column(1).to_pylist()]
            columns = [pa.array([len(r[k]) for r in rows], pa.int64()) for k in KINDS]
            hashes = pa.array([hashlib.sha256(listed(r, BASE_KINDS).encode()).hexdigest() for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), *columns, hashes, pa.array([listed(r, KINDS) for r in rows], pa.string())], names)


def find_personal_data(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per document: counts per kind, base_sha256 and spans.

    A null or empty text has no spans. A null id stays null; repeated rows are searched one by one; an empty table gives
    no rows; other columns are not read, whatever their names. Whole texts are searched, whatever their length. Spans of
    one kind never overlap; spans of different kinds may. Kinds ``url`` and ``account`` come besides the base ones.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_run, ", ".join(["doc_id long", *(f"n_{k} long" for k in KINDS), "base_sha256 string", "spans string"]))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in angle brackets; null stays null."""

    @F.pandas_udf("string")
    def cleaned(texts):
        anchors = _automaton()

        def one(t):
            if t is None:
                return None
            out, at = [], 0
            for a, b, k in sorted((a, -b, k) for k, found in spans(t, anchors).items() for a, b in found):
                if a >= at:
                    out += [t[at:a], f"<{k}>"]
                    at = -b
            return "".join([*out, t[at:]])

        return texts.map(one, na_action="ignore")

    return docs.withColumn(text, cleaned(F.col(text)))
