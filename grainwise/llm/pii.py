"""PII: format-preserving pseudonyms from keyed Feistel networks, in built-in expressions.

Candidates are found by one pattern, validated (Luhn, mod 97, octets, calendar, area
codes) and replaced by a keyed permutation of their own format: a card stays a card
with a right check digit, a date a date, an address an address. A value always gets
the same pseudonym under one key, so equal values stay linked across documents; the
numeric permutations are bijections and can be undone with the key.

A network alternates ``L = (L + f(R)) mod a`` and ``R = (R + f(L)) mod b``, which
permutes any domain of ``a * b`` values; ``f`` is SHA-256 of key, kind, round and the
other half. Letters and digits of mail names and secrets are permuted character by
character by the same scheme, each within its own class.

Defined cases: a null text stays null and an empty one empty; candidates that fail
validation stay as they are; a value met again gets the same pseudonym; the whole value
of a secret is permuted, however long, dots included; all columns of the input are kept,
whatever their names, and only the text column changes; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.llm.common import free_name

ROUNDS = 8
#: For tests and examples; a deployment passes a key of its own.
EXAMPLE_KEY = "example key, not a secret"

# The patterns of each kind, tried in this order at each position.
PATTERNS = {
    "email": r"(?<![\w.%+\-])[\w.%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)*+(?<=\.[A-Za-z]{2,24})",
    "aws_key": r"(?<![A-Za-z0-9])A(?:KIA|SIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z])(?i:password|passwd|pwd|token|secret|api[_\-]?key)[\x22']?\s{0,4}[=:]\s{0,4}[\x22']?[A-Za-z0-9_\-+/.=~]{6,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "date": r"(?<![\d\-/.])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/]|[\-.]\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d]|-\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?!\d)",
    "card": r"(?<![\d])\d(?:[ \-]?\d){12,18}(?!\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text with none of these characters holds no candidate.
SIGN = r"[0-9@=]|(?i:password|passwd|pwd|token|secret|key)[\x22']?\s{0,4}:"
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
FIRST_DAY, DAY_CYCLE = "1800-01-01", (189, 773)  # 189 * 773 = 146,097 days, the 400 years to 2199-12-31


# --- networks ------------------------------------------------------------------------


def _f(key: str, kind: str, rnd: Column, other: Column) -> Column:
    """60 bits of the round function."""
    seen = F.concat_ws("|", F.lit(key), F.lit(kind), rnd.cast("string"), other.cast("string"))
    return F.conv(F.substring(F.sha2(seen.cast("binary"), 256), 1, 15), 16, 10).cast("bigint")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str, undo: bool = False) -> Column:
    """Struct (l, r): a keyed permutation of Z_a x Z_b."""
    sign = -1 if undo else 1

    def step(s: Column, r: Column) -> Column:
        return F.when(
            r % 2 == 0, F.struct(F.pmod(s["l"] + sign * (_f(key, kind, r, s["r"]) % a), a).alias("l"), s["r"].alias("r"))
        ).otherwise(
            F.struct(s["l"].alias("l"), F.pmod(s["r"] + sign * (_f(key, kind, r, s["l"]) % b), b).alias("r"))
        )

    rounds = list(range(ROUNDS))
    order = F.array(*[F.lit(r) for r in (reversed(rounds) if undo else rounds)])
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(order, start, step)


def permute_digits(digits: Column, key: str, kind: str, undo: bool = False) -> Column:
    """A string of 2 to 18 digits to one of the same length."""
    n = F.length(digits)
    h = F.floor(n / 2).cast("int")
    a, b = F.pow(F.lit(10), h).cast("bigint"), F.pow(F.lit(10), n - h).cast("bigint")
    left = F.substring(digits, F.lit(1), h).cast("bigint")
    right = F.substring(digits, h + 1, n - h).cast("bigint")
    out = feistel(left, right, a, b, key, kind, undo)
    return _bound(out, lambda o: F.concat(F.lpad(o["l"].cast("string"), h, "0"), F.lpad(o["r"].cast("string"), n - h, "0")))


def _bound(value: Column, use) -> Column:
    """``use`` over a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shift(c: Column, k: Column, undo: bool, hexed: Column) -> Column:
    sign = -1 if undo else 1

    def within(alphabet: str) -> Column:
        at = F.pmod(F.instr(F.lit(alphabet), c) - 1 + sign * k % len(alphabet), F.lit(len(alphabet)))
        return F.substring(F.lit(alphabet), at.cast("int") + 1, F.lit(1))

    return (
        F.when(hexed, within(HEX)).when(c.rlike("^[0-9]$"), within(DIGITS)).when(c.rlike("^[a-z]$"), within(LOWER))
        .when(c.rlike("^[A-Z]$"), within(UPPER)).otherwise(c)
    )


def permute_text(text: Column, key: str, kind: str, undo: bool = False) -> Column:
    """Letters and digits permuted in their places; a lower-case hex string stays one."""
    hexed = text.rlike("^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{8,}$")
    return _bound(hexed, lambda known: _permuted(text, key, kind, undo, known))


def _permuted(text: Column, key: str, kind: str, undo: bool, hexed: Column) -> Column:
    h = F.floor(F.length(text) / 2).cast("int")

    def moved(part: Column, other: Column, rnd: Column) -> Column:
        """Every character by its place and the digest of the other half, so the work is linear."""
        return _bound(
            F.sha2(other.cast("binary"), 256),
            lambda digest: F.array_join(
                F.transform(
                    F.split(part, ""),
                    lambda c, i: F.when(c == "", c).otherwise(_shift(c, _f(key, kind, F.concat_ws(".", rnd, i), digest), undo, hexed)),
                ),
                "",
            ),
        )

    def step(s: Column, r: Column) -> Column:
        return F.when(r % 2 == 0, F.struct(moved(s["l"], s["r"], r).alias("l"), s["r"].alias("r"))).otherwise(
            F.struct(s["l"].alias("l"), moved(s["r"], s["l"], r).alias("r"))
        )

    rounds = list(range(ROUNDS))
    order = F.array(*[F.lit(r) for r in (reversed(rounds) if undo else rounds)])
    start = F.struct(F.substring(text, F.lit(1), h).alias("l"), F.substring(text, h + 1, F.length(text)).alias("r"))
    return F.aggregate(order, start, step, lambda s: F.concat(s["l"], s["r"]))


# --- formats -------------------------------------------------------------------------


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in order."""
    return _bound(
        digits,
        lambda d: F.array_join(
            F.transform(
                F.split(shape, ""),
                lambda c, i: F.when(
                    c.rlike("^[0-9]$"), F.substring(d, F.length(_digits(F.substring(shape, F.lit(1), i + 1))), F.lit(1))
                ).otherwise(c),
            ),
            "",
        ),
    )


def _luhn(digits: Column) -> Column:
    """Luhn sum of digits whose last one counts once."""
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _mod97(text: Column) -> Column:
    def add(rest: Column, c: Column) -> Column:
        return F.when(c == "", rest).when(c.rlike("^[0-9]$"), (rest * 10 + c.cast("int")) % 97).otherwise(
            (rest * 100 + F.ascii(c) - 55) % 97
        )

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def card(m: Column, key: str) -> Column:
    d = _digits(m)
    inner = permute_digits(F.substring(d, F.lit(2), F.length(d) - 2), key, "card")

    def closed(x: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), x)
        return F.concat(body, F.pmod(-_luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))

    return F.when(_luhn(d) % 10 == 0, _refill(m, _bound(inner, closed))).otherwise(m)


def phone(m: Column, key: str) -> Column:
    d = _digits(m)
    n = F.length(d)
    tail = F.substring(d, n - 9, F.lit(10))
    area, office, line = (F.substring(tail, F.lit(s), F.lit(k)).cast("bigint") for s, k in ((1, 3), (4, 3), (7, 4)))
    own = feistel(area - 200, (office - 200) * 10_000 + line, F.lit(800), F.lit(8_000_000), key, "phone")
    american = _bound(
        own,
        lambda o: F.concat(
            F.substring(d, F.lit(1), n - 10), (o["l"] + 200).cast("string"),
            (F.floor(o["r"] / 10_000) + 200).cast("string"), F.lpad((o["r"] % 10_000).cast("string"), 4, "0"),
        ),
    )
    other = F.concat(F.substring(d, 1, 2), permute_digits(F.substring(d, F.lit(3), n - 2), key, "phone"))
    national = (n == 10) | ((n == 11) & d.startswith("1"))
    return (
        F.when(national & (area >= 200) & (office >= 200), _refill(m, american))
        .when(n.between(7, 15), _refill(m, other)).otherwise(m)
    )


def ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("bigint"))
    left, right = parts[0] * 256 + parts[1], parts[2] * 256 + parts[3]
    own = feistel(left, right, F.lit(65_536), F.lit(65_536), key, "ip")
    text = _bound(
        own,
        lambda o: F.concat_ws(
            ".", F.floor(o["l"] / 256).cast("string"), (o["l"] % 256).cast("string"),
            F.floor(o["r"] / 256).cast("string"), (o["r"] % 256).cast("string"),
        ),
    )
    return F.when(F.forall(parts, lambda x: x < 256), text).otherwise(m)


def ssn(m: Column, key: str) -> Column:
    d = _digits(m)
    area, group, serial = (F.substring(d, s, k).cast("bigint") for s, k in ((1, 3), (4, 2), (6, 4)))
    left = area - 1 - F.when(area > 666, 1).otherwise(0)
    own = feistel(left, (group - 1) * 9_999 + serial - 1, F.lit(898), F.lit(99 * 9_999), key, "ssn")

    def text(o: Column) -> Column:
        a = o["l"] + 1 + F.when(o["l"] >= 665, 1).otherwise(0)
        return F.concat_ws(
            "-", F.lpad(a.cast("string"), 3, "0"), F.lpad((F.floor(o["r"] / 9_999) + 1).cast("string"), 2, "0"),
            F.lpad((o["r"] % 9_999 + 1).cast("string"), 4, "0"),
        )

    right = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(right, _bound(own, text)).otherwise(m)


def date(m: Column, key: str) -> Column:
    """The same day gets the same pseudonym in whatever notation it is written."""
    a, b = DAY_CYCLE
    first = F.lit(FIRST_DAY).cast("date")
    two, four = r"^\d{2}", r"^\d{4}-"
    cases = (
        (m.rlike(four), "yyyy-MM-dd", "yyyy-MM-dd"),
        (m.rlike(two + r"\."), "dd.MM.yyyy", "dd.MM.yyyy"),
        (m.rlike(two + r"/\d{2}/"), "d/M/yyyy", "dd/MM/yyyy"),
        (m.rlike("/"), "d/M/yyyy", "d/M/yyyy"),
        (m.rlike(two + r"/\d{2}/"), "M/d/yyyy", "MM/dd/yyyy"),
        (m.rlike("/"), "M/d/yyyy", "M/d/yyyy"),
    )

    def written(moved: Column, pattern: str) -> Column:
        return _bound(moved, lambda o: F.date_format(F.date_add(first, (o["l"] * b + o["r"]).cast("int")), pattern))

    out = []
    for holds, reads, writes in cases:
        day = F.when(holds, F.try_to_timestamp(m, F.lit(reads)).cast("date"))
        n = F.datediff(day, first)
        moved = feistel(F.floor(n / b), n % b, F.lit(a), F.lit(b), key, "date")
        out.append(F.when((n >= 0) & (n < a * b), written(moved, writes)))
    return F.coalesce(*out, m)


def iban(m: Column, key: str) -> Column:
    bare = F.replace(m, F.lit(" "))
    country, account = F.substring(bare, 1, 2), F.substring(bare, F.lit(5), F.length(bare))
    right = (F.length(bare).between(15, 34)) & (_mod97(F.concat(account, country, F.substring(bare, 3, 2))) == 1)

    def text(x: Column) -> Column:
        check = F.lpad((98 - _mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0")
        return _spaced(m, F.concat(country, check, x))

    return F.when(right, _bound(permute_text(account, key, "iban"), text)).otherwise(m)


def _spaced(shape: Column, text: Column) -> Column:
    """``text`` with the spaces of ``shape``."""
    return _bound(
        text,
        lambda t: F.array_join(
            F.transform(
                F.split(shape, ""),
                lambda c, i: F.when(c == " ", c).otherwise(
                    F.substring(t, F.length(F.replace(F.substring(shape, F.lit(1), i + 1), F.lit(" "))), F.lit(1))
                ),
            ),
            "",
        ),
    )


def email(m: Column, key: str) -> Column:
    name = F.substring_index(m, "@", 1)
    return F.concat(permute_text(F.lower(name), key, "email"), F.substring(m, F.length(name) + 1, F.length(m)))


def aws_key(m: Column, key: str) -> Column:
    return F.concat(F.substring(m, 1, 4), permute_text(F.substring(m, 5, 16), key, "aws"))


_NAME = r"^.*?[\x22']?\s{0,4}[=:]\s{0,4}[\x22']?"


def secret(m: Column, key: str) -> Column:
    value = F.regexp_replace(m, _NAME, "")
    head = F.substring(m, F.lit(1), F.length(m) - F.length(value))
    right = value.rlike("[0-9]") | m.rlike("[\\x22']")
    return F.when(right, F.concat(head, permute_text(value, key, "secret"))).otherwise(m)


KINDS = {
    "email": email, "aws_key": aws_key, "secret": secret, "iban": iban, "ip": ip, "date": date, "ssn": ssn,
    "phone": phone, "card": card,
}


# --- operator ------------------------------------------------------------------------


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one candidate, by the first kind whose pattern it is."""
    out = m
    for kind in reversed(KINDS):
        out = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), KINDS[kind](m, key)).otherwise(out)
    return out


def pseudonymise(df: DataFrame, text: str = "text", key: str = EXAMPLE_KEY, found: str | None = None) -> DataFrame:
    """Replaces the text column; ``found`` names a column for the number of replacements."""
    body = F.col(text)
    likely = body.rlike(SIGN)
    matches = F.when(likely, F.regexp_extract_all(body, F.lit(ANY), F.lit(0)))
    kept = df.columns
    old, new = free_name("_old", kept), free_name("_new", kept)
    df = df.withColumn(old, matches).withColumn(new, F.transform(old, lambda m: pseudonym(m, key)))
    gaps = F.split(body, ANY, -1)
    rebuilt = F.when(
        F.size(old) > 0,
        F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col(new), i), F.lit("")))), ""),
    ).otherwise(body)
    changed = F.coalesce(F.size(F.filter(F.arrays_zip(old, new), lambda p: p[old] != p[new])), F.lit(0))
    columns = [rebuilt.alias(text) if c == text else F.col(f"`{c}`") for c in kept]
    return df.select(*columns, *([changed.cast("bigint").alias(found)] if found else []))


def private_removed(docs: DataFrame, key: str = EXAMPLE_KEY) -> DataFrame:
    """Whole rows with pseudonyms in the text; ``n_chars`` follows."""
    kinds = dict(docs.dtypes)
    out = pseudonymise(docs, key=key)
    return out.select(*[(F.length("text").cast(kinds[c]) if c == "n_chars" else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, found="n_replaced")
