"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Numbers, dates, addresses and tokens are found by their format and validated (check
digits, octets, calendar, area codes). The digits that carry the value are read as one
number below the size of their format and permuted within it: two halves take turns in
adding a keyed hash of the other one, and what falls outside the format is permuted
again. So a pseudonym has the format of its value and passes the same checks, equal
values get equal pseudonyms in all documents, different values different ones, and who
has the key can turn them back (`restore`). Spaces and hyphens within numbers play no
part, nor do the notations of a date, but for days that are written first with slashes:
these stay days after the 12th, so that the notation can still be told.

Kinds: email (letters and digits before the @), phone, ip (v4), card (Luhn), ssn, iban
(mod 97), date (any day of 1900 to 2099), secret (32 to 128 hexadecimal digits).

A run of groups may be longer than the value it begins with: a card number with a code
or an expiry date after it, an IBAN with a BIC. Of a run that starts like a card, the
longest part up to a group's end that passes the check is the value; of an IBAN, the part
of its country's length (`IBAN_LENGTHS`; the whole run for other countries or if that
fails). The search goes on behind it. Card pseudonyms also keep the check sum of the
number as if one digit followed, so a longer part passes the check just if it did before,
and the way back finds the same values.

Nothing is looked up or collected: every row is worked on alone, and a task remembers
at most `REMEMBERED` pseudonyms. The key is a parameter; keep it out of code.

Defined results: null stays null, with no findings; texts of any length are read whole;
values that fail their check stay as they are. Overlapping findings: the first one that
starts earliest, in the order of the kinds. Repeated rows each get a result.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from stockyard.shipping import ship_by_value

ship_by_value(__name__)

ROUNDS = 8
REMEMBERED = 100_000
KINDS = ("email", "iban", "secret", "ip", "date", "ssn", "phone", "card")
RESULT = "struct<text string, n_private bigint, kinds array<string>>"

# Lengths of the countries' IBANs.
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2099, 12, 31).toordinal() - _FIRST_DAY + 1
_HAS_ANY = re.compile(r"[0-9@]|[0-9A-Fa-f]{32}")
#: What keeps its form under a pseudonym and may follow a card, so a card's run ends before it both ways.
_EMAIL = r"(?<![\w.%+\-])[\w.%+\-]{0,63}[\w%+\-]@(?:[A-Za-z0-9\-]{1,63}\.)+[A-Za-z]{2,24}(?![\w\-])"
_IP = r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])"
_DATE = r"(?<![\w./\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?!\w|[./\-][0-9])"
_SSN = r"(?<![\w\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w\-])"
_PHONE = (
    r"(?<![\w+])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{1,4}(?:[ .\-]?[0-9]{2,4}){1,4}"
    r"|(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4})(?!\w)"
)
_FIND = re.compile(
    rf"(?P<email>{_EMAIL})"
    r"|(?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<secret>(?<!\w)(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?!\w))"
    rf"|(?P<ip>{_IP})|(?P<date>{_DATE})|(?P<ssn>{_SSN})|(?P<phone>{_PHONE})"
    r"|(?P<card>(?<![\w.])[0-9](?:[ \-]?[0-9]){12}"
    rf"(?:(?:[ \-](?!{_EMAIL}|{_IP}|{_DATE}|{_SSN}|{_PHONE}))?[0-9]){{0,6}}(?!\w))"
)


def luhn(digits: str) -> int:
    """The sum that is a multiple of ten for valid numbers."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


class Cipher:
    """A keyed permutation of the numbers below any size."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = blake2b(key, digest_size=32).digest(), back

    def _add(self, kind: str, turn: int, size: int, other: int) -> int:
        raw = f"{kind}|{size}|{turn}|{other}".encode()
        return int.from_bytes(blake2b(raw, key=self.key, digest_size=48).digest(), "big")

    def permute(self, value: int, size: int, kind: str) -> int:
        """`value` is below `size`; both halves together hold hardly more numbers than that."""
        if size < 2:
            return value
        b = 1
        while b * b < size:  # the least power of two whose square suffices
            b *= 2
        a = -(-size // b)
        while True:
            left, right = divmod(value, b)
            for turn in reversed(range(ROUNDS)) if self.back else range(ROUNDS):
                sign = -1 if self.back else 1
                if turn % 2 == 0:
                    left = (left + sign * self._add(kind, turn, size, right)) % a
                else:
                    right = (right + sign * self._add(kind, turn, size, left)) % b
            value = left * b + right
            if value < size:
                return value

    def characters(self, text: str, kind: str) -> str:
        """Permute ASCII letters and digits within their positions' alphabets; case and all else stays."""
        spots = [(k, c, "0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz") for k, c in enumerate(text) if c.isascii() and c.isalnum()]
        value, size = 0, 1
        for _, c, alphabet in spots:
            value = value * len(alphabet) + alphabet.index(c.lower())
            size *= len(alphabet)
        shape = "".join("9" if len(alphabet) == 10 else "a" for _, _, alphabet in spots)
        value = self.permute(value, size, f"{kind}{shape}")
        out = list(text)
        for k, c, alphabet in reversed(spots):
            value, digit = divmod(value, len(alphabet))
            out[k] = alphabet[digit].upper() if c.isupper() else alphabet[digit]
        return "".join(out)

    def digits(self, digits: str, kind: str) -> str:
        value = self.permute(int(digits), 10 ** len(digits), f"{kind}{len(digits)}") if digits else 0
        return str(value).zfill(len(digits)) if digits else digits


def _refill(pattern: str, digits: str) -> str:
    """The digits in the places of the pattern's digits."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in pattern)


def _email(text: str, c: Cipher) -> str | None:
    local, at, domain = text.rpartition("@")
    return c.characters(local, "email") + at + domain


def _iban(text: str, c: Cipher) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain) != 1:
        return None
    length, new = IBAN_LENGTHS.get(plain[:2], len(plain)), plain
    while True:
        body = c.characters(new[4:], f"iban{plain[:2]}")
        new = plain[:2] + f"{98 - _mod97(plain[:2] + '00' + body):02d}" + body
        # A run of another length must not begin with a value of the right one.
        if length >= len(plain) or _mod97(new[:length]) != 1:
            break
    rest = iter(new)
    return "".join(" " if x == " " else next(rest) for x in text)


def _secret(text: str, c: Cipher) -> str | None:
    value = c.permute(int(text, 16), 16 ** len(text), f"secret{len(text)}")
    out = f"{value:0{len(text)}x}"
    return out.upper() if text.upper() == text else out


def _ip(text: str, c: Cipher) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255:
        return None
    value = c.permute(int.from_bytes(bytes(octets), "big"), 1 << 32, "ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _date(text: str, c: Cipher) -> str | None:
    parts = [int(x) for x in re.split(r"[./\-]", text)]
    if "-" in text:
        order = (0, 1, 2)
    elif "." in text or parts[0] > 12:
        order = (2, 1, 0)  # day first
    else:
        order = (2, 0, 1)  # month first
    try:
        day = datetime.date(*(parts[k] for k in order)).toordinal() - _FIRST_DAY
    except ValueError:
        return None
    if not 0 <= day < _DAYS:
        return None
    day_first = order == (2, 1, 0) and "/" in text
    new, value = None, day
    while new is None or (day_first and new.day <= 12):
        value = c.permute(value, _DAYS, "days" if day_first else "date")
        new = datetime.date.fromordinal(value + _FIRST_DAY)
    widths = [len(x) for x in re.split(r"[./\-]", text)]
    fields = dict(zip(order, (new.year, new.month, new.day), strict=True))
    padded = all(w == 2 for w, k in zip(widths, range(3), strict=True) if k != order[0])
    marks = re.findall(r"[./\-]", text)
    out = [str(fields[k]).zfill(4 if k == order[0] else 2 if padded else 1) for k in range(3)]
    return out[0] + marks[0] + out[1] + marks[1] + out[2]


def _ssn(text: str, c: Cipher) -> str | None:
    area, group, serial = (int(x) for x in text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    rank = area - 1 - (area > 666)
    value = c.permute((rank * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn")
    value, serial = divmod(value, 9999)
    rank, group = divmod(value, 99)
    area = rank + 1 + (rank >= 665)
    return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(text: str, c: Cipher) -> str | None:
    country = re.match(r"\+[0-9]{1,3}(?=[ .\-(])|\+1|", text)[0]
    rest = re.sub(r"[^0-9]", "", text[len(country) :])
    if not 6 <= len(rest) <= 14 or len(re.sub(r"[^0-9]", "", text)) > 15:
        return None
    return country + _refill(text[len(country) :], c.digits(rest, f"phone{country}"))


def _card(text: str, c: Cipher) -> str | None:
    plain = re.sub(r"[^0-9]", "", text)
    if luhn(plain):
        return None
    new, followed = plain, luhn(plain + "0")
    while True:
        body = c.digits(new[:-1], "card")
        new = body + str(-luhn(body + "0") % 10)
        if luhn(new + "0") == followed:
            return _refill(text, new)


def _parts(kind: str, run: str) -> Iterator[str]:
    """What may be the value at the beginning of a run, in order of preference."""
    if kind == "iban":
        length = IBAN_LENGTHS.get(run[:2], 0)
        for end in (m.start() for m in re.finditer(" ", run)):
            if end - run.count(" ", 0, end) == length:
                yield run[:end]
    yield run
    if kind == "card":
        for end in reversed([m.start() for m in re.finditer(r"[ \-]", run)]):
            if sum(map(str.isdigit, run[:end])) >= 13:
                yield run[:end]


_HANDLERS = dict(zip(KINDS, (_email, _iban, _secret, _ip, _date, _ssn, _phone, _card), strict=True))


class Pseudonyms:
    def __init__(self, key: bytes, back: bool = False):
        self.cipher, self.known = Cipher(key, back), {}

    def replace(self, text: str) -> tuple[str, list[str]]:
        """The text with pseudonyms, and the kinds of the values replaced, in order."""
        kinds: list[str] = []
        if not _HAS_ANY.search(text):
            return text, kinds

        out, at = [], 0
        while found := _FIND.search(text, at):
            kind, run = found.lastgroup, found[0]
            out.append(text[at : found.start()])
            at = found.end()
            for value in _parts(kind, run):
                new = self._pseudonym(kind, value)
                if new is not None:
                    kinds.append(kind)
                    out.append(new)
                    at = found.start() + len(value)
                    break
            else:
                out.append(run)
        out.append(text[at:])
        return "".join(out), kinds

    def _pseudonym(self, kind: str, value: str) -> str | None:
        """None for what fails its check."""
        new = self.known.get((kind, value), 0)
        if new == 0:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            new = self.known[kind, value] = _HANDLERS[kind](value, self.cipher)
        return new


def pseudonymise(key: bytes, text: str | Column = "text", back: bool = False) -> Column:
    """A struct column: the text with pseudonyms, how many there are, and their kinds."""

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Pseudonyms(key, back)
        for texts in batches:
            rows = [(None, []) if t is None else own.replace(t) for t in texts.to_pylist()]
            yield pa.StructArray.from_arrays(
                [
                    pa.array([t for t, _ in rows], pa.string()),
                    pa.array([len(k) for _, k in rows], pa.int64()),
                    pa.array([sorted(set(k)) for _, k in rows], pa.list_(pa.string())),
                ],
                ["text", "n_private", "kinds"],
            )

    return run(F.col(text) if isinstance(text, str) else text)


def restore(key: bytes, text: str | Column = "text") -> Column:
    """The inverse of `pseudonymise`, for who has the key."""
    return pseudonymise(key, text, back=True)
