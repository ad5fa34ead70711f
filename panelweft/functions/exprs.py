"""Column expressions: coercions, row-wise aggregates, text and scoring expressions. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text that counts as true.
TRUE_TEXT = ("true", "1", "yes")
#: Words that are no search tokens.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "may", "might", "shall", "can", "to", "of", "in", "for", "on", "with", "at", "by", "from",
    "as", "into", "through", "during", "before", "after", "and", "but", "or", "nor", "not", "so", "yet", "both", "either",
    "neither", "each", "every", "all", "any", "few", "more", "most", "other", "some", "such", "no", "only", "own", "same",
    "than", "too", "very", "just", "because", "this", "that", "these", "those", "it", "its", "he", "she", "they", "them",
    "we", "us", "you", "i", "me", "my", "your", "his", "her", "our", "their", "what", "which", "who", "whom", "how",
    "when", "where", "why", "if", "then", "else", "about",
)
#: Substrings that tell an indicator's domain, in order of priority.
DOMAIN_MARKS = (
    ("SKL", ("skill", "literacy", "education", "school", "enroll", "training", "learning")),
    ("ACC", ("internet", "mobile", "broadband", "connect")),
    ("SRV", ("service", "government systems", "govtech")),
    ("AGR", ("trust", "governance", "inclusion", "equity")),
    ("ECO", ("finance", "payment", "trade", "economic")),
    ("OUT", ("co2", "emission", "resilience", "sustainability")),
)
#: The domain of an indicator whose text tells none, by its pillar.
PILLAR_DOMAIN = {"access_usage": "ACC", "trust_governance": "AGR", "affordability_inclusion": "ECO", "sustainability_resilience": "OUT"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: Column | str) -> Column:
    """Text as a double; null where it isn't a finite number."""
    s = F.trim(_col(c).cast("string"))
    return F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))


def finite(c: Column | str) -> Column:
    """A double with NaN and infinities as null."""
    x = _col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def to_bool(c: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(_col(c).cast("string"))).isin(*TRUE_TEXT), F.lit(False))


def year_of_period(c: Column | str) -> Column:
    """The year that the text of a period begins with ("2014-15" is 2014)."""
    s = F.trim(_col(c).cast("string"))
    return F.when(s.rlike("^[0-9]{4}"), F.substring(s, 1, 4).try_cast("int"))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(F.trim(_col(c).cast("string")), F.lit("")) == ""


def row_count(columns: Sequence[Column | str]) -> Column:
    """How many of the columns aren't null."""
    return reduce(lambda a, b: a + b, [_col(c).isNotNull().cast("int") for c in columns])


def row_mean(columns: Sequence[Column | str]) -> Column:
    """Mean of the columns that aren't null; null if all are."""
    return F.try_divide(reduce(lambda a, b: a + b, [F.coalesce(_col(c).cast("double"), F.lit(0.0)) for c in columns]), row_count(columns))


def weighted_mean(columns: Sequence[Column | str], weights: Sequence[Column | float]) -> Column:
    """Weighted mean of the columns that aren't null; null where their weights sum to 0."""
    ws = [w if isinstance(w, Column) else F.lit(float(w)) for w in weights]
    num = reduce(lambda a, b: a + b, [F.coalesce(_col(c).cast("double"), F.lit(0.0)) * w for c, w in zip(columns, ws, strict=True)])
    den = reduce(lambda a, b: a + b, [F.when(_col(c).isNotNull(), w).otherwise(0.0) for c, w in zip(columns, ws, strict=True)])
    return F.try_divide(num, F.when(den != 0, den))


def oriented(value: Column | str, direction: Column | str) -> Column:
    """The value, with its sign turned where less is better."""
    return F.when(F.lower(F.trim(_col(direction))) == "negative", -_col(value)).otherwise(_col(value))


def trust_tier(measure: Column | str, high: float, medium: float) -> Column:
    return F.when(_col(measure) >= high, "High").when(_col(measure) >= medium, "Medium").otherwise("Low")


def ordinal(c: Column | str, order: dict[str, int], default: int = 0) -> Column:
    out = F.lit(default)
    for k, v in order.items():
        out = F.when(_col(c) == k, v).otherwise(out)
    return out


def classify_domain(name: Column | str, code: Column | str, pillar: Column | str) -> Column:
    """An indicator's domain by the first mark in its name or code, else by its pillar, else OUT."""
    low = lambda c: F.lower(F.trim(F.coalesce(_col(c).cast("string"), F.lit(""))))
    text = F.concat_ws(" ", low(name), low(code))
    out = F.lit("OUT")
    for p, d in reversed(PILLAR_DOMAIN.items()):
        out = F.when(low(pillar) == p, d).otherwise(out)
    for domain, marks in reversed(DOMAIN_MARKS):
        hit = reduce(lambda a, b: a | b, [text.contains(m) for m in marks])
        if domain == "SKL":
            hit |= low(code).startswith("wb_se.")
        out = F.when(hit, domain).otherwise(out)
    return out


def replaced(c: Column | str, mapping: dict[str, str]) -> Column:
    """Values recoded by a mapping; others stay."""
    out = _col(c)
    for k, v in mapping.items():
        out = F.when(_col(c) == k, F.lit(v)).otherwise(out)
    return out


def strip_tags(c: Column | str) -> Column:
    """Markup removed, white space collapsed."""
    plain = F.regexp_replace(F.regexp_replace(_col(c), r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def raw_tokens(c: Column | str) -> Column:
    """Runs of word characters (of any script) in lower case, whatever their length; stop words too."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), r"(?U)[^\w\s]", " ")), r"(?U)\s+")


def tokens(c: Column | str) -> Column:
    """Search tokens: raw_tokens() longer than 1 without stop words."""
    return F.filter(raw_tokens(c), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def slug(c: Column | str) -> Column:
    s = F.regexp_replace(F.lower(F.trim(_col(c))), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(s, r"(?U)[\s_]+", "-"), "^-+|-+$", "")


def title_of(content: Column | str, fallback: Column | str) -> Column:
    """The first heading of a document, else the fallback in title case."""
    h1 = F.regexp_extract(_col(content), r"(?m)^#\s+(.+)$", 1)
    return F.when(h1 != "", F.trim(h1)).otherwise(F.initcap(F.regexp_replace(_col(fallback), "[-_]", " ")))


def body_of(content: Column | str) -> Column:
    """A document without its front matter."""
    return F.regexp_replace(_col(content), r"(?s)\A---\n.*?\n---\n", "")


def summary_of(content: Column | str, max_words: int = 150) -> Column:
    """The first paragraph of more than 30 characters that is no heading, cut to max_words."""
    paragraphs = F.transform(F.split(body_of(content), r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    first = F.get(F.filter(paragraphs, lambda p: (F.length(p) > 30) & ~p.startswith("#")), 0)
    words = F.split(first, " ")
    return F.when(F.size(words) > max_words, F.concat(F.array_join(F.slice(words, 1, max_words), " "), F.lit("..."))).otherwise(F.coalesce(first, F.lit("")))


def wikilinks(content: Column | str) -> Column:
    """Targets of [[links]]; what follows a bar is a label."""
    return F.transform(F.regexp_extract_all(_col(content), F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1)), lambda t: F.trim(t))


def concepts_of(content: Column | str) -> Column:
    """Bold phrases and second- or third-level headings, distinct."""
    bold = F.regexp_extract_all(_col(content), F.lit(r"\*\*([^*]+)\*\*"), F.lit(1))
    heads = F.regexp_extract_all(_col(content), F.lit(r"(?m)^#{2,3}\s+(.+)$"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(F.concat(bold, heads), lambda t: F.trim(t)), lambda t: F.length(t) > 2))


def snippet(content: Column | str, terms: Sequence[str], width: int = 200) -> Column:
    """width characters about the first place of any term."""
    low = F.lower(_col(content))
    spots = F.filter(F.array(*[F.instr(low, t) for t in terms]), lambda i: i > 0)
    start = F.greatest(F.coalesce(F.array_min(spots), F.lit(1)) - width // 4, F.lit(1))
    return F.trim(F.regexp_replace(_col(content).substr(start, F.lit(width)), r"\s+", " "))


def short_id(*columns: Column | str, length: int = 24) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(_col(c).cast("string"), F.lit("")) for c in columns]), 256), 1, length)


def salted_hash(c: Column | str, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), F.lit(":"), F.trim(_col(c))), 256)


def parse_time(c: Column | str) -> Column:
    """ISO-8601 or RFC-2822 text as a timestamp (session zone); null where it is neither."""
    s = F.regexp_replace(F.trim(_col(c)), r"^[A-Za-z]{3},\s*", "")
    s = F.regexp_replace(s, r"\s(GMT|UTC|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(s), F.try_to_timestamp(s, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(s, F.lit("d MMM yyyy HH:mm Z")))


#: Named character references.
REFERENCES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "bull": "•", "middot": "·", "copy": "©", "reg": "®", "trade": "™", "euro": "€", "pound": "£", "deg": "°"}


def unescaped(c: Column | str) -> Column:
    """Text with its named, decimal and hexadecimal character references as characters, each once (&amp;lt; is &lt;)."""
    out = _col(c)
    for name, char in REFERENCES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    found = F.array_distinct(F.regexp_extract_all(out, F.lit(r"&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(1)))
    hexed = lambda e: F.when(F.lower(F.substring(e, 1, 1)) == "x", F.substring(e, 2, 6)).otherwise(F.conv(e, 10, 16))
    known = lambda e: F.conv(hexed(e), 16, 10).cast("long").between(1, 0x10FFFF) & ~F.conv(hexed(e), 16, 10).cast("long").between(0xD800, 0xDFFF)
    char = lambda e: F.decode(F.unhex(F.lpad(hexed(e), 8, "0")), "UTF-32")
    out = F.aggregate(F.filter(found, known), out, lambda t, e: F.replace(t, F.concat(F.lit("&#"), e, F.lit(";")), char(e)))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def word_chunks(c: Column | str, size: int, overlap: int = 0) -> Column:
    """Runs of size words, each beginning overlap words before the end of the one before; an empty text has none."""
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size")
    words = F.filter(F.split(F.trim(F.coalesce(_col(c), F.lit(""))), r"\s+"), lambda w: w != "")

    def chunks(ws: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(ws), F.lit(1)), F.lit(size - overlap)), lambda i: (F.size(ws) > 0) & ((i == 1) | (i + overlap <= F.size(ws))))
        return F.transform(starts, lambda i: F.array_join(F.slice(ws, i, size), " "))

    return F.get(F.transform(F.array(words), chunks), 0)  # bound as a lambda's variable: a text is split once, not once a chunk


def sentences(c: Column | str) -> Column:
    """What a text's full stops, question and exclamation marks end."""
    return F.filter(F.transform(F.split(F.coalesce(_col(c), F.lit("")), r"(?<=[.!?])\s+"), lambda t: F.trim(t)), lambda t: t != "")


def title_case(c: Column | str) -> Column:
    return F.initcap(F.regexp_replace(_col(c), "[-_]", " "))


def uniform(seed: int, *columns: Column | str) -> Column:
    """A number in (0, 1) that the seed and the values fix: the same in every run and on every executor."""
    return (F.pmod(F.xxhash64(F.lit(seed), *[_col(c).cast("string") for c in columns]), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)


def normal(seed: int, *columns: Column | str) -> Column:
    """A standard normal number fixed like uniform()."""
    return F.sqrt(-2 * F.log(uniform(seed, *columns, F.lit("r")))) * F.cos(6.283185307179586 * uniform(seed, *columns, F.lit("a")))


def poisson(mean: float, seed: int, *columns: Column | str) -> Column:
    """A Poisson number fixed like uniform(), by the inverse of its distribution (up to mean + 12 standard deviations + 12)."""
    import math

    most, p, total, sums = int(mean + 12 * math.sqrt(mean) + 12), math.exp(-mean), 0.0, []
    for k in range(most):
        total += p
        sums.append(total)
        p *= mean / (k + 1)
    u = uniform(seed, *columns)
    return F.size(F.filter(F.array(*[F.lit(x) for x in sums]), lambda x: x < u))


def chosen(values: Sequence, seed: int, *columns: Column | str) -> Column:
    """One of the values, fixed like uniform()."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(uniform(seed, *columns) * len(values)) + 1).cast("int"))
