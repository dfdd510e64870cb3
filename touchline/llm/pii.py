"""Personal data by anchor expansion (operator 9).

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, "://" and cue words of accounts. Only there do
deterministic parsers run; each grows its anchor to the left and right, and validates what it got.

Base kinds (email, ip, card, phone) give what these expressions match, leftmost and without overlaps inside a kind, matches
that fail validation being dropped without a retry:

* email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
* ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), each part at most 255
* card   [0-9]([\\x20-]?[0-9])+, 16 to 19 digits that pass Luhn's test
* phone  \\+[0-9][\\x20().0-9-]+[0-9], 8 to 15 digits

The method adds url (scheme://host...) and account: what follows an identifier cue (password=, token = "...", iban ...) and
has a digit, or an access key that starts with AKIA.

Null texts count as empty, empty texts have no spans. Every row gives one row, repeated rows too, and texts of any length are
scanned whole. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

from touchline.llm.common import per_row, spark_schema

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")

DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LOCAL = LETTERS | DIGITS | frozenset("._%+-")
LABEL = LETTERS | DIGITS | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
KEY = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ") | DIGITS
SECRET = LETTERS | DIGITS | frozenset("_-+/.=")
SCHEMES = ("http", "https", "ftp", "ftps", "ssh", "mailto")
LONGEST_SCHEME = max(map(len, SCHEMES))
#: Words before an account's value; the value follows after "=" or ":" (blanks and a quote may stand between).
CUES = ("password", "passwd", "token", "secret", "api_key", "apikey", "iban", "account", "username", "user_id", "login")
KEY_CUE, KEY_LENGTH = "AKIA", 20
MIN_ACCOUNT = 6


def automaton():
    """Anchors by kind. Cue words are there in lower case, capitalised and in upper case."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    for word, kind in (("@", "email"), ("+", "phone"), ("://", "url"), (KEY_CUE, "key")):
        found.add_word(word, (kind, len(word)))
    for cue in CUES:
        for form in {cue, cue.capitalize(), cue.upper()}:
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def run_of(text: str, at: int, chars: frozenset) -> int:
    """End of the run of chars that starts at a position."""
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around an at-sign; its start is at floor at least."""
    begin = at
    while begin > floor and text[begin - 1] in LOCAL:
        begin -= 1
    end = run_of(text, at + 1, LABEL)
    if begin == at or end == at + 1:
        return None
    labels = 0
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in LABEL:
        end = run_of(text, end + 1, LABEL)
        labels += 1
    return (begin, end) if labels else None


def address_at(text: str, at: int) -> tuple[int, list[str]] | None:
    """Four groups of digits with dots between, from a group's first digit: their end and the groups."""
    end = run_of(text, at, DIGITS)
    parts = [text[at:end]]
    while len(parts) < 4:
        stop = run_of(text, end + 1, DIGITS) if end < len(text) and text[end] == "." else end
        if stop <= end + 1:
            return None
        parts.append(text[end + 1 : stop])
        end = stop
    return end, parts


def digits_at(text: str, at: int) -> int:
    """End of the digits that have one blank or hyphen between them at most."""
    n, end = len(text), at + 1
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    return end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def phone_at(text: str, at: int) -> int | None:
    """End of the number that a plus sign opens."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    last = run_of(text, at + 2, PHONE) - 1
    while last >= at + 3 and text[last] not in DIGITS:
        last -= 1
    return last + 1 if last >= at + 3 else None


def url_at(text: str, at: int) -> tuple[int, int] | None:
    """Scheme, host and the rest up to white space, quotes or brackets, around "://"."""
    begin = at
    while begin > max(0, at - LONGEST_SCHEME - 1) and text[begin - 1] in LETTERS:
        begin -= 1
    if text[begin:at].lower() not in SCHEMES:
        return None
    end = at + 3
    while end < len(text) and not text[end].isspace() and text[end] not in "\"'<>()[]{}":
        end += 1
    while end > at + 3 and text[end - 1] in ".,;:!?":
        end -= 1
    return (begin, end) if end > at + 3 else None


def value_at(text: str, end_of_cue: int) -> int | None:
    """Where the value after a cue word begins."""
    at = run_of(text, end_of_cue, frozenset(" "))
    if at >= len(text) or text[at] not in "=:":
        return None
    return run_of(text, run_of(text, at + 1, frozenset(" ")), frozenset("\"'"))


def account_at(text: str, at: int) -> tuple[int, int, bool]:
    """The value that begins there, the end of what was read for it, and whether it can be one."""
    read = end = run_of(text, at, SECRET)
    while end > at and text[end - 1] in ".-=":
        end -= 1
    value = text[at:end]
    return end, read, len(value) >= MIN_ACCOUNT and any(c in DIGITS for c in value)


def key_at(text: str, at: int) -> tuple[int, int] | None:
    end = at + KEY_LENGTH
    alone = (at == 0 or text[at - 1] not in SECRET) and (end == len(text) or text[end : end + 1] not in LETTERS | KEY)
    return (at, end) if alone and end <= len(text) and all(c in KEY for c in text[at:end]) else None


def find_spans(text: str | None, anchors) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in order of their starts."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return spans
    #: Up to where each kind has read: matches that were dropped count as read, too.
    read = dict.fromkeys((*KINDS, "group", "value"), 0)
    for last, (kind, length) in anchors.iter(text):
        at = last - length + 1
        if kind == "digit":
            if at >= read["group"]:  # a group's first digit, or what a match has left of it
                read["group"] = run_of(text, at, DIGITS)
                if at >= read["ip"] and (found := address_at(text, at)):
                    end, parts = found
                    read["ip"] = end
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
                        spans["ip"].append((at, end))
            if at >= read["card"]:
                read["card"] = end = digits_at(text, at)
                digits = text[at:end].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    spans["card"].append((at, end))
        elif kind == "email":
            if found := email_at(text, at, read["email"]):
                read["email"] = found[1]
                spans["email"].append(found)
        elif kind == "phone":
            if at >= read["phone"] and (end := phone_at(text, at)):
                read["phone"] = end
                if 8 <= sum(c in DIGITS for c in text[at:end]) <= 15:
                    spans["phone"].append((at, end))
        elif kind == "url":
            if at >= read["url"] and (found := url_at(text, at)):  # no other scheme opens inside a url's run
                read["url"] = found[1]
                spans["url"].append(found)
        elif kind == "key":
            if at >= read["account"] and (found := key_at(text, at)):
                read["account"] = found[1]
                spans["account"].append(found)
        elif (begin := value_at(text, at + length)) is not None and begin >= read["value"]:
            # a value inside what was read for another is a part of that: no longer, and with no other digits
            end, read["value"], fits = account_at(text, begin)
            if fits and begin >= read["account"]:
                read["account"] = end
                spans["account"].append((begin, end))
    return spans


def joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{b}:{e}" for k in kinds for b, e in spans[k])


def redact(text: str | None, spans: dict[str, list[tuple[int, int]]]) -> str | None:
    """The text with each span replaced by its kind in brackets; spans that overlap become one, of the first one's kind."""
    if not text:
        return text
    out, at, open_end = [], 0, 0
    for begin, end, kind in sorted((b, e, k) for k in KINDS for b, e in spans[k]):
        if begin >= open_end:
            out += [text[at:begin], f"[{kind.upper()}]"]
        open_end = at = max(open_end, end)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_url, n_account, n_spans (of all kinds), has_pii of every row of
    docs(doc_id, text, ...). has_pii: there are spans other than urls, which alone name nobody. No shuffle."""
    added = [*((f"n_{k}", pa.int64()) for k in (*KINDS[len(BASE_KINDS) :], "spans")), ("has_pii", pa.bool_())]
    out = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE_KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), *added])

    def make():
        anchors = automaton()

        def row(doc_id, text):
            spans = find_spans(text, anchors)
            n = {k: len(spans[k]) for k in KINDS}
            added = (n["url"], n["account"], sum(n.values()), sum(n.values()) > n["url"])
            return (doc_id, *(n[k] for k in BASE_KINDS), hashlib.sha256(joined(spans, BASE_KINDS).encode()).hexdigest(), joined(spans, KINDS), *added)

        return row

    return docs.select("doc_id", "text").mapInArrow(per_row(["doc_id", "text"], out, make), spark_schema(out))


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced; n_chars follows the text. Null texts stay null. All columns of docs, in their order."""
    names = docs.columns
    types = dict(docs.dtypes)

    def run(batches):
        anchors = automaton()
        hide = partial(_redacted, anchors=anchors)
        for batch in batches:
            texts = [hide(x.as_py()) for x in batch.column(batch.schema.get_field_index("text"))]
            cells = {f.name: batch.column(k) for k, f in enumerate(batch.schema)}
            cells["text"] = pa.array(texts, batch.schema.field("text").type)
            if "n_chars" in cells:
                lengths = [old if t is None else len(t) for t, old in zip(texts, cells["n_chars"].to_pylist(), strict=True)]
                cells["n_chars"] = pa.array(lengths, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(cells.values()), schema=batch.schema)

    return docs.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names))


def _redacted(text, anchors):
    return redact(text, find_spans(text, anchors))
