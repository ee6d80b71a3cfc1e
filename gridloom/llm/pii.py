r"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of a whole text in one pass: at-signs, schemes, digit pairs, plus-digits
and identifier cues. Local parsers then grow each anchor to its boundaries and validate what they have.

Kinds, in the order in which they are listed: ``email``, ``ip``, ``card`` (Luhn), ``phone`` are the base kinds, with
leftmost non-overlapping spans per kind. The method adds ``url`` (an address that carries user information),
``address`` (house number and street cue), ``account`` (IBAN by its check digits; a number that an account cue names)
and ``secret`` (a password, token or key that is assigned: with a digit, or quoted, after an equals sign, of 16
characters or more, or of mixed case or signs). An added span other than ``url`` that lies inside a base span is left out; one that
holds base spans stays beside them. Runs have no greatest length.

Defined cases: null text has no spans; spans count code points, end exclusive; repeated rows give repeated results; an
empty table gives an empty result; columns other than id and text are ignored (``redact`` keeps them as they are).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, texts

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "address", "account", "secret")
_ORDER = {k: i for i, k in enumerate(KINDS)}

#: Cues (fixed values), matched in lower, title and upper case.
ACCOUNT_CUES = ("account", "acct", "routing number", "passport", "ssn", "social security", "kontonummer", "compte", "cuenta")
SECRET_CUES = ("password", "passwd", "pwd", "passphrase", "token", "secret", "api key", "access key", "secret key", "private key", "encryption key", "client secret")
STREET_CUES = (" street", " st.", " avenue", " ave.", " road", " rd.", " boulevard", " blvd", " lane", "straße", "strasse")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = "0123456789"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL_REST = re.compile(r"://[^\s/?#@:]+(?::[^\s/?#@]*)?@[^\s/?#@]+[^\s]*")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
_IBAN_STARTS = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_NAMED_NUMBER = re.compile(r"(?:[ ]?(?:no\.?|nr\.?|number|#))?[ ]?[:=#]?[ ]?([A-Z0-9](?:[ -]?[A-Z0-9])*+)(?![A-Za-z0-9])")
_ASSIGNED = re.compile(r"""["']?[ ]?([:=])[ ]?(["']?)(?=[A-Za-z0-9_+/=.-]{8})""")
_VALUE = re.compile(r"[A-Za-z0-9_+/=.-]+")
_HOUSE = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,5}[A-Za-z]?(?: [^\W\d_][\w.'-]*){1,4}$")
_HOUSE_AFTER = re.compile(r" [0-9]{1,4}[a-z]?(?![0-9A-Za-z])")


def _forms(cue: str) -> set[str]:
    """A cue in lower, title and upper case; one of several words also joined by underscore, hyphen or in camel case."""
    cases = lambda c: {c, c.title(), c if "ß" in c else c.upper()}
    first, *rest = cue.strip().split(" ")
    if not rest or cue.startswith(" "):
        return cases(cue)
    camel = first + "".join(w.title() for w in rest)
    return {camel, *(f for gap in (" ", "_", "-", "") for f in cases(cue.replace(" ", gap)))}


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """The anchors; each key carries (what it announces, its length)."""
    out = ahocorasick.Automaton()
    found: dict[str, set[str]] = {"@": {"email"}, "://": {"url"}}
    for a in _DIGITS:
        found.setdefault(f"{a}.", set()).add("ip")
        found.setdefault(f"+{a}", set()).add("phone")
        for b in _DIGITS:
            for gap in ("", " ", "-"):
                found.setdefault(a + gap + b, set()).add("card")
    for what, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES), ("address", STREET_CUES)):
        for cue in cues:
            for form in _forms(cue):
                found.setdefault(form, set()).add(what)
    for key, what in found.items():
        out.add_word(key, (tuple(sorted(what)), len(key)))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _iban(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str, anchors: list[int]) -> list[tuple[int, int]]:
    out, floor = [], 0
    for at in anchors:
        if at < floor or not (m := _DOMAIN.match(text, at + 1)):
            continue
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            floor = m.end()
            out.append((start, floor))
    return out


def _ips(text: str, anchors: list[int]) -> list[tuple[int, int]]:
    out, floor = [], 0
    for at in anchors:
        if at < floor:
            continue
        start = at
        while start > floor and text[start - 1] in _DIGITS:
            start -= 1
        if m := _IP.match(text, start):
            floor = m.end()
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(m.span())
    return out


def _runs(text: str, anchors: list[int], pattern: re.Pattern, least: int, most: int, check=None) -> list[tuple[int, int]]:
    """Anchored matches whose digits number ``least`` to ``most`` and pass ``check``."""
    out, floor = [], 0
    for at in anchors:
        if at < floor or not (m := pattern.match(text, at)):
            continue
        floor = m.end()
        digits = [c for c in m[0] if c in _DIGITS]
        if least <= len(digits) <= most and (check is None or check(digits)):
            out.append(m.span())
    return out


def _urls(text: str, anchors: list[int]) -> list[tuple[int, int]]:
    out = []
    for at in anchors:
        start = at
        while start > 0 and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+.-")):
            start -= 1
        if start < at and (m := _URL_REST.match(text, at)):
            out.append((start, m.end()))
    return out


def _addresses(text: str, anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for start, end in anchors:
        if end < len(text) and text[end].isalnum():
            continue
        if text[start] == " ":
            low = start
            for _ in range(5):  # a number and up to four words
                low = max(0, text.rfind(" ", 0, low))
            if m := _HOUSE.search(text, low, start):
                out.append((m.start(), end))
        elif m := _HOUSE_AFTER.match(text, end):
            while start > 0 and text[start - 1].isalpha():
                start -= 1
            out.append((start, m.end()))
    return out


def _ibans(text: str, pairs: list[int]) -> list[tuple[int, int]]:
    """Valid IBANs, from the digit pairs that hold their check digits."""
    out, floor = [], 0
    for at in pairs:
        if at - 2 < floor or not _IBAN_STARTS.match(text, at - 2) or not (m := _IBAN.match(text, at - 2)):
            continue
        code = m[0]
        while code and not _iban(code):  # words in capitals may follow
            code = code.rpartition(" ")[0]
        if code:
            floor = at - 2 + len(code)
            out.append((at - 2, floor))
    return out


def _accounts(text: str, anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, stop = [], 0
    for start, end in anchors:
        if end < stop or start and text[start - 1].isalnum():  # cues inside a run have no more digits than the run
            continue
        if m := _NAMED_NUMBER.match(text, end):
            stop = m.end()
            if len(m[1]) >= 6 and sum(c in _DIGITS for c in m[1]) >= 6:
                out.append(m.span(1))
    return out


def _secrets(text: str, anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, stop, digit = [], 0, -1
    for _, end in anchors:
        if not (m := _ASSIGNED.match(text, end)):
            continue
        start = m.end()
        if start >= stop:  # cues inside a value share its end and its last digit
            stop = _VALUE.match(text, start).end()
            digit = max(text.rfind(d, start, stop) for d in _DIGITS)
        if digit >= start or m[1] == "=" or m[2] or stop - start >= 16 or _mixed(text[start : start + 16]):
            out.append((start, stop))
    return out


def _mixed(value: str) -> bool:
    """Whether a value looks like no word: capitals after its first character beside small letters, or a sign inside."""
    inner = value.rstrip("._-")[1:]
    return any(c in "+/=_" for c in inner) or any(c.isupper() for c in inner) and any(c.islower() for c in value)


def find(text: str) -> list[tuple[int, int, str]]:
    """Spans of a whole text as (start, end, kind), by start, then kind as listed."""
    anchors: dict[str, list[tuple[int, int]]] = {}
    for last, (what, size) in automaton().iter(text):
        for kind in what:
            anchors.setdefault(kind, []).append((last - size + 1, last + 1))
    if not anchors:
        return []
    starts = {k: sorted(s for s, _ in v) for k, v in anchors.items()}
    base = {
        "email": _emails(text, starts.get("email", [])),
        "ip": _ips(text, starts.get("ip", [])),
        "card": _runs(text, starts.get("card", []), _CARD, 12, 19, luhn),
        "phone": _runs(text, starts.get("phone", []), _PHONE, 9, 15),
    }
    out = [(s, e, k) for k, spans in base.items() for s, e in spans]
    taken = _reach([(s, e) for s, e, _ in out])
    out += [(s, e, "url") for s, e in _urls(text, starts.get("url", []))]
    added = [(s, e, "address") for s, e in _addresses(text, anchors.get("address", []))]
    ibans = _ibans(text, starts.get("card", []))
    added += [(s, e, "account") for s, e in ibans]
    known = _reach(ibans)
    added += [(s, e, "account") for s, e in _accounts(text, anchors.get("account", [])) if known(e - 1) <= s]
    added += [(s, e, "secret") for s, e in _secrets(text, anchors.get("secret", []))]
    out += [(s, e, k) for s, e, k in set(added) if taken(s) < e]
    return sorted(out, key=lambda x: (x[0], _ORDER[x[2]], x[1]))


def _reach(spans: list[tuple[int, int]]) -> Callable[[int], int]:
    """A function that gives the furthest end of the spans that start at a place or before (0 if there is none)."""
    spans = sorted(spans)
    starts, ends = [a for a, _ in spans], [0, *accumulate((b for _, b in spans), max)]
    return lambda at: ends[bisect_right(starts, at)]


def label(spans: list[tuple[int, int, str]]) -> str:
    """``kind:start:end``, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans, for every row; no shuffle."""
    id_type = dict(df.dtypes)[id_col]
    names = [id_col, *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, sha, spans = [[] for _ in BASE_KINDS], [], []
        for text in texts(batch.column(1)):
            found = find(text)
            base = [x for x in found if x[2] in BASE_KINDS]
            for n, kind in zip(counts, BASE_KINDS, strict=True):
                n.append(sum(x[2] == kind for x in base))
            sha.append(hashlib.sha256(label(base).encode()).hexdigest())
            spans.append(label(found))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(n, pa.int64()) for n in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string())], names)

    schema = f"`{id_col}` {id_type}, " + ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, spans string"
    return map_batches(df.select(id_col, text_col), run, schema)


def masked(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, under the first kind."""
    if not text or not (spans := find(text)):
        return text
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns of ``df`` with spans masked in the text; ``length_col``, if there, is counted anew."""
    schema = df.schema
    at = schema.names.index(text_col)
    count = schema.names.index(length_col) if length_col in schema.names else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(batch.columns)
        new = [masked(t) for t in columns[at].to_pylist()]
        columns[at] = pa.array(new, columns[at].type)
        if count is not None:
            old = columns[count].to_pylist()
            columns[count] = pa.array([n if t is None else len(t) for n, t in zip(old, new, strict=True)], columns[count].type)
        return pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return map_batches(df, run, schema)
