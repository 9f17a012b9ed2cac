"""Personal data under format-preserving pseudonyms.

Values that pass their format's own test (check digits, calendars, number ranges) are mapped to whole numbers of a
domain that holds just the format's valid values, permuted there by a keyed Feistel network, and written back in the
same layout. The result is valid again, nothing of the value shows without the key, no value is its own pseudonym, and
equal values get equal pseudonyms in every document, so links survive.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import prepare

#: Pass a key of your own; this one only makes results repeatable.
KEY = b"sparkloom example key"
_ROUNDS = 8
#: Letters and digits that are permuted as one number; longer values go block by block.
_BLOCK = 128


def permute(value: int, size: int, key: bytes, tweak: str, *, back: bool = False) -> int:
    """Keyed permutation of range(size): a Feistel network over two halves of bits, repeated until inside the range.

    Half the bits of the domain bound each round's output, so the walk takes four steps at most on average; it cannot
    run for ever, as a permutation's cycle leads back to the value itself.
    """
    if not 0 <= value < size:
        raise ValueError("value outside its domain")
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    wide = (half + 7) // 8
    bound = size.to_bytes((size.bit_length() + 7) // 8)
    person = hashlib.blake2b(tweak.encode("utf-8", "surrogatepass") + b"/" + bound, digest_size=16).digest()

    def scramble(r: int, x: int) -> int:
        out, n = b"", 0
        while len(out) < wide:
            out += hashlib.blake2b(r.to_bytes(1) + n.to_bytes(4) + x.to_bytes(wide), key=key[:64], person=person, digest_size=64).digest()
            n += 1
        return int.from_bytes(out[:wide]) & mask

    while True:
        left, right = value >> half, value & mask
        if back:
            for r in reversed(range(_ROUNDS)):
                left, right = right ^ scramble(r, left), left
        else:
            for r in range(_ROUNDS):
                left, right = right, left ^ scramble(r, right)
        value = left << half | right
        if value < size:
            return value


def pseudonym(value: int, size: int, key: bytes, tweak: str) -> int:
    """Another number of range(size) for `value`, where there is one: a step of one in the permuted order.

    That is a permutation as well (a conjugate of the step), and like the step it leaves no number in its place.
    """
    if size == 1:
        return value
    return permute((permute(value, size, key, tweak) + 1) % size, size, key, tweak, back=True)


def luhn_digit(payload: str) -> str:
    """The check digit that makes `payload` plus it pass the Luhn test."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(payload)))
    return str(-total % 10)


def _fill(layout: str, digits: str) -> str:
    """`layout` with its digits replaced in order."""
    it = iter(digits)
    return re.sub(r"[0-9]", lambda _: next(it), layout)


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


Permute = Callable[[int, int, str], int]


def _card(m: re.Match, p: Permute) -> str | None:
    d = _digits(m[0])
    if len(set(d)) == 1 or luhn_digit(d[:-1]) != d[-1]:
        return None
    # The first digit, which names the kind of card, stays; the check digit follows from the rest.
    n = len(d) - 2
    body = d[0] + str(p(int(d[1:-1]), 10**n, "card")).zfill(n)
    return _fill(m[0], body + luhn_digit(body))


def _phone(m: re.Match, p: Permute) -> str | None:
    if m["area"] is not None:
        d = _digits(m["area"]) + m["exchange"] + m["line"]
        if d[0] in "01" or d[3] in "01":
            return None
        value = (int(d[:3]) - 200) * 800 * 10_000 + (int(d[3:6]) - 200) * 10_000 + int(d[6:])
        rest, line = divmod(p(value, 800 * 800 * 10_000, "phone"), 10_000)
        area, exchange = divmod(rest, 800)
        return (m["one"] or "") + _fill(m[0][len(m["one"] or "") :], f"{area + 200}{exchange + 200}{line:04d}")
    d = _digits(m["national"])
    if not 6 <= len(d) <= 13:
        return None
    return m["country"] + _fill(m["national"], str(p(int(d), 10 ** len(d), f"phone{m['country']}")).zfill(len(d)))


def _ip(m: re.Match, p: Permute) -> str | None:
    parts = m[0].split(".")
    if any(int(x) > 255 or str(int(x)) != x for x in parts):
        return None
    v = p(int.from_bytes(bytes(map(int, parts))), 1 << 32, "ip")
    return ".".join(map(str, v.to_bytes(4)))


_FIRST, _DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days


def _date(m: re.Match, p: Permute) -> str | None:
    if m["iso"]:
        y, a, b, order = m["y1"], m["m1"], m["d1"], "ymd"
    else:
        y, a, b = m["y2"], m["a2"], m["b2"]
        order = "mdy" if m["sep2"] == "/" and int(a) <= 12 else "dmy"
    month, day = (b, a) if order == "dmy" else (a, b)
    try:
        date = datetime.date(int(y), int(month), int(day))
    except ValueError:
        return None
    n = (date - _FIRST).days
    if not 0 <= n < _DAYS:
        return None
    new = _FIRST + datetime.timedelta(p(n, _DAYS, "date"))
    sep = m["sep1"] or m["sep2"]
    return sep.join(f"{getattr(new, {'y': 'year', 'm': 'month', 'd': 'day'}[c]):02d}" for c in order)


def _ssn(m: re.Match, p: Permute) -> str | None:
    a, g, s = map(int, m[0].split("-"))
    if a in (0, 666) or a >= 900 or not g or not s:
        return None
    areas = a - 1 - (a > 666)
    rest, s = divmod(p((areas * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999, "ssn"), 9999)
    a, g = divmod(rest, 99)
    return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"


@functools.lru_cache(maxsize=4096)
def _class(block: int, category: str) -> str:
    """The characters of a block of 128 code points that have the given Unicode category."""
    return "".join(chr(c) for c in range(128 * block, 128 * block + 128) if unicodedata.category(chr(c)) == category)


def _class_of(char: str) -> str:
    """What a letter or digit may turn into: those of its kind in its block, so a-z, A-Z and 0-9, or Cyrillic small letters."""
    category = unicodedata.category(char)
    return _class(ord(char) >> 7, category) if category[0] in "LN" else char


def _by_class(text: str, p: Permute, tweak: str) -> str | None:
    """Letters and digits permuted within their classes, all else as it is; secrets in lower-case hex stay hex.

    Values are permuted in blocks of `_BLOCK` characters, each under a tweak made of all blocks before it, so the work is
    linear in the length and the whole stays a permutation. None if nothing can change.
    """
    hexed = tweak == "secret" and re.fullmatch(r"[0-9a-f]+", text)
    before, out, changed = hashlib.blake2b(digest_size=16), [], False
    for start in range(0, len(text), _BLOCK):
        block = text[start : start + _BLOCK]
        classes = ["0123456789abcdef" if hexed else _class_of(x) for x in block]
        value, size = 0, 1
        for x, c in zip(block, classes, strict=True):
            value, size = value * len(c) + c.index(x), size * len(c)
        value = p(value, size, f"{tweak}/{before.hexdigest()}" if start else tweak)
        changed |= size > 1
        written = []
        for c in reversed(classes):
            value, r = divmod(value, len(c))
            written.append(c[r])
        out += reversed(written)
        before.update(block.encode("utf-8", "surrogatepass"))
    return "".join(out) if changed else None


def _iban(m: re.Match, p: Permute) -> str | None:
    plain = m[0].replace(" ", "")

    def remainder(s: str) -> int:
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97

    if not 15 <= len(plain) <= 34 or remainder(plain) != 1:
        return None
    body = _by_class(plain[4:], p, "iban") or plain[4:]
    new = iter(plain[:2] + f"{98 - remainder(plain[:2] + '00' + body):02d}" + body)
    return "".join(c if c == " " else next(new) for c in m[0])


def _email(m: re.Match, p: Permute) -> str | None:
    name, _, host = m[0].rpartition("@")
    if sum(len(_class_of(c)) > 1 for c in name) >= 4:
        return f"{_by_class(name, p, f'email{host}')}@{host}"
    stem, dot, top = host.rpartition(".")  # a short name alone has few values to turn into
    return _by_class(f"{name}@{stem}", p, "email") + dot + top


def _secret(m: re.Match, p: Permute) -> str | None:
    part, head = ("value", 0) if m["aws"] is None else ("aws", 4)
    new = _by_class(m[part][head:], p, "secret" if part == "value" else "key")
    start, end = m.start(part) - m.start() + head, m.end(part) - m.start()
    return None if new is None else m[0][:start] + new + m[0][end:]


#: Kinds in order of precedence: name, pattern, and the function that tests a match and writes its pseudonym.
KINDS: tuple[tuple[str, re.Pattern, Callable[[re.Match, Permute], str | None]], ...] = (
    ("secret", re.compile(r"\b(?P<aws>(?:AKIA|ASIA)[0-9A-Z]{16}|(?:ghp_|gho_|sk-|xox[abp]-)[0-9A-Za-z-]{16,})\b|\b(?i:password|passwd|pwd|secret|token|api[_-]?key)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?P<value>[\w+/.\-]{8,}=*)"), _secret),
    ("email", re.compile(r"(?<![\w.+%-])[\w.+%-]{1,64}@(?:(?:[^\W_]|-){1,63}\.){1,8}[^\W\d_]{2,24}(?![\w-])"), _email),
    ("iban", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?\b"), _iban),
    ("ip", re.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])"), _ip),
    (
        "date",
        re.compile(r"(?<![\w.-])(?:(?P<iso>(?P<y1>[0-9]{4})(?P<sep1>[-/.])(?P<m1>[0-9]{2})(?P=sep1)(?P<d1>[0-9]{2}))|(?P<a2>[0-9]{2})(?P<sep2>[-/.])(?P<b2>[0-9]{2})(?P=sep2)(?P<y2>[0-9]{4}))(?![\w-]|\.[0-9])"),
        _date,
    ),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"), _ssn),
    (
        "phone",
        re.compile(r"(?<![\w+])(?:(?P<one>\+?1[ .-]?)?(?P<area>\([0-9]{3}\)|[0-9]{3})[ .-]?(?P<exchange>[0-9]{3})[ .-](?P<line>[0-9]{4})|(?P<country>\+[0-9]{1,3})(?P<national>(?:[ .-]?\(?[0-9]{1,5}\)?){2,6}))(?!\w)"),
        _phone,
    ),
    ("card", re.compile(r"(?<![\w.-])(?:[0-9]{13,19}|[0-9]{4}(?P<s>[ -])[0-9]{4}(?P=s)[0-9]{4}(?P=s)[0-9]{1,7}|[0-9]{4}(?P<t>[ -])[0-9]{6}(?P=t)[0-9]{5})(?![\w]|\.[0-9])"), _card),
)
#: No kind matches without one of these.
_HINT = re.compile(r"[0-9@]|(?i:passw|pwd|secret|token|api)|A[KS]IA|gh[po]_|sk-|xox")


def pseudonymise(text: str, key: bytes = KEY) -> tuple[str, list[str]]:
    """`text` with pseudonyms, and the kinds found in order; of matches that overlap, the kind listed first wins."""
    if not _HINT.search(text):
        return text, []

    def p(value: int, size: int, tweak: str) -> int:
        return pseudonym(value, size, key, tweak)

    found: list[tuple[int, int, str, str]] = []
    for kind, pattern, write in KINDS:
        taken, fresh = [a for a, _, _, _ in found], []
        for m in pattern.finditer(text):
            after = bisect.bisect_left(taken, m.end())  # of the ranges taken, the last that starts before the match's end
            if after and found[after - 1][1] > m.start():
                continue
            new = write(m, p)
            if new is not None:
                fresh.append((m.start(), m.end(), kind, new))
        found = sorted(found + fresh)
    if not found:
        return text, []
    out, at = [], 0
    for a, b, _, new in found:
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:], [k for _, _, k, _ in found]


def pseudonymise_documents(docs: DataFrame, *, text_col: str = "text", key: bytes = KEY, kinds_col: str | None = None) -> DataFrame:
    """`docs` with pseudonyms in the text column, all other columns as they are, whatever their names and types.

    With `kinds_col`, a column of the kinds found is added. Defined results: a null text stays null, an empty one empty;
    repeated rows stay alike; an empty table stays empty. Rows are handled one by one, in no shuffle.
    """
    prepare(docs.sparkSession)
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    text = inner[[n.lower() for n in names].index(text_col.lower())]
    rows = docs.toDF(*inner).withColumn(text, F.col(text).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            done = [(None, []) if t is None else pseudonymise(t, key) for t in batch.column(at).to_pylist()]
            arrays = list(batch.columns)
            arrays[at] = pa.array([d[0] for d in done], batch.schema.field(at).type)
            arrays.append(pa.array([d[1] for d in done], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "found"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    out = rows.mapInArrow(run, f"{schema}, found array<string>")
    return out.drop("found").toDF(*names) if kinds_col is None else out.toDF(*names, kinds_col)
