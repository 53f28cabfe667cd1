"""Text as column expressions: cleaning, checking and masking model output and messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and lists. Fixed values.
SECRETS = (
    r"postgres(?:ql)?://[^\s\"'\\]+",
    r"npg_[A-Za-z0-9]{8,}",
    r"sk-[A-Za-z0-9]{20,}",
    r"AKIA[A-Z0-9]{16}",
    r"AIza[A-Za-z0-9_\-]{30,}",
)
PLACEHOLDERS = ("pass", "password", "secret", "xxx", "xxxx", "your_password", "user", "username", "example", "changeme", "123456", "***")
FORBIDDEN_FOR_CUSTOMERS = ("biên", "margin", "lãi", "giá gốc", "giá nhà xe", "carrier_cost", "internal")
FORBIDDEN_KEYS = ("internal", "margin", "base_margin_pct", "carrier_cost", "min_margin_amount", "pricing_rule")
EMPTY_ANSWER = "Xin lỗi, tôi chưa tạo được câu trả lời cho câu này. Bạn thử hỏi lại ngắn gọn hơn giúp tôi nhé."
DEDUPE_FROM = 40  # characters from which a repeated line goes
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NUMBER = r"\d[\d.,]*\d|\d"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def stripped(text: Column) -> Column:
    """Without white space, of any script, at both ends."""
    return F.btrim(text, F.lit(SPACES))


def strip_think(text: Column) -> Column:
    """What follows the last closing reasoning tag; of a text whose tag isn't closed, what comes before it."""
    closed = F.substring_index(text, "</think>", -1)
    return stripped(F.when(text.contains("</think>"), closed).otherwise(F.substring_index(text, "<think>", 1)))


def dedupe_lines(text: Column) -> Column:
    """Drop lines that, trimmed, are long and came before; JSON-like text stays as it is.

    Lines are sorted by (key, place) and each is compared with the one before, so the work is that of a sort; short lines have keys of their own.
    """
    lines = F.split(text, "\n", -1)

    def keyed(line: Column, i: Column) -> Column:
        key = stripped(line)
        return F.struct(F.when(F.length(key) >= DEDUPE_FROM, key).alias("k"), i.alias("i"), line.alias("line"))

    def kept(rows: Column) -> Column:
        first = F.transform(rows, lambda r, j: F.struct(r["i"].alias("i"), r["line"].alias("line"), (r["k"].isNull() | (j == 0) | ~r["k"].eqNullSafe(F.get(rows, j - 1)["k"])).alias("new")))
        return F.transform(F.array_sort(F.filter(first, lambda r: r["new"])), lambda r: r["line"])

    sorted_ = F.transform(F.array(F.array_sort(F.transform(lines, keyed))), kept)
    return F.when(text.rlike(r"^\s*[\{\[]"), text).otherwise(F.array_join(F.element_at(sorted_, 1), "\n"))


def clean_output(text: Column) -> Column:
    """Remove reasoning (closed, unclosed, orphan tags) and fences, then repeated lines; never empty."""
    for pattern in (r"(?is)<think>.*?</think>", r"(?is)<think>.*$", r"(?is)^.*?</think>", r"```json\s*", "```"):
        text = F.regexp_replace(text, pattern, "")
    done = once(stripped(text), lambda t: stripped(dedupe_lines(t)))
    return once(done, lambda d: F.when(F.coalesce(d, F.lit("")) == "", EMPTY_ANSWER).otherwise(d))


def user_content(text: Column) -> Column:
    """What stands behind [USER REQUEST] up to the next bracket; without such a part the whole text."""
    mark = r"(?s)\[USER REQUEST\]\s*(.*?)(?=\[|$)"
    return F.when(text.rlike(r"\[USER REQUEST\]"), stripped(F.regexp_extract(text, mark, 1))).otherwise(text)


def numbers_in(text: Column) -> Column:
    """The distinct numbers of a text without their separators."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)), lambda x: F.regexp_replace(x, "[.,]", "")))


def invented_numbers(answer: Column, context: Column, min_digits: int = 4) -> Column:
    """Numbers of ``min_digits`` digits or more of the answer that the context hasn't."""
    return F.array_except(F.filter(numbers_in(answer), lambda x: F.length(x) >= min_digits), numbers_in(context))


def customer_leak(text: Column) -> Column:
    """Words of the inside that a text for customers must not have."""
    return F.regexp_extract_all(text, F.lit(r"(?iU)\b(" + "|".join(FORBIDDEN_FOR_CUSTOMERS) + r")\b"), F.lit(1))


def found_secrets(text: Column) -> Column:
    """Secrets in a text, but for connection strings whose user or password is an obvious placeholder."""
    hits = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)) for p in SECRETS]))
    url = r"^postgres(?:ql)?://([^:/@]+)(?::([^@]*))?@(.*)"

    def placeholder(x: Column) -> Column:
        user, password, host = (F.regexp_extract(x, url, i) for i in (1, 2, 3))
        return x.rlike(url) & ((password == "") | F.lower(password).isin(*PLACEHOLDERS) | F.lower(user).isin(*PLACEHOLDERS) | host.rlike(r"^(\.\.\.|host|<|example\.)"))

    return F.filter(hits, lambda x: ~placeholder(x))


def redact(text: Column) -> Column:
    """Replace secrets."""
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, "[SECRET]")
    return text


def redact_map(fields: Column) -> Column:
    """Hide forbidden keys of a map of texts, and secrets in the others."""
    return F.transform_values(fields, lambda k, v: F.when(k.isin(*FORBIDDEN_KEYS), F.lit("[ĐÃ ẨN]")).otherwise(redact(v)))


def clean_markdown(text: Column) -> Column:
    """Drop images and heading signs, keep the words of links, at most one empty line."""
    text = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", "")
    text = F.regexp_replace(text, r"\[([^\]]+)\]\([^)]*\)", "$1")
    text = F.regexp_replace(text, r"(?m)^#+\s*", "")
    return stripped(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def mask_phone(text: Column) -> Column:
    return F.regexp_replace(text, ".(?=.{3})", "X")


def mask_email(text: Column) -> Column:
    return F.regexp_replace(text, "^(.)[^@]*@", "$1***@")


def fuzzy_contains(text: Column, part: Column) -> Column:
    """Contains, whatever the case and the accents."""
    kind = "UNICODE_CI_AI"
    return F.contains(F.collate(text, kind), F.collate(part, kind))


def price_in_page(text: Column, pattern: str, low: int, high: int) -> Column:
    """The first number behind ``pattern``; null where there is none or it is out of range, so that it is never stored."""
    value = F.regexp_replace(F.regexp_extract(text, pattern, 1), "[.,]", "").try_cast("long")
    return F.when(value.between(low, high), value)


def missing_fields(required: dict[str, Column]) -> Column:
    """Labels of what is null or blank, in order."""
    return F.filter(F.array(*[F.when(F.coalesce(F.trim(c.cast("string")), F.lit("")) == "", F.lit(k)) for k, c in required.items()]), lambda x: x.isNotNull())


def guard_sql(statement: Column) -> Column:
    """Why a statement isn't read-only; null if it is."""
    word = F.upper(F.regexp_extract(statement, r"(?i)\b(DROP|TRUNCATE|DELETE|ALTER|UPDATE|INSERT|GRANT|REVOKE|CREATE)\b", 1))
    return F.when(word != "", F.concat(F.lit("writes: "), word)).when(~F.upper(statement).contains("SELECT"), "no SELECT")


#: Names of the days from Monday on. Fixed values.
WEEKDAYS = ("thứ Hai", "thứ Ba", "thứ Tư", "thứ Năm", "thứ Sáu", "thứ Bảy", "Chủ nhật")


def extraction_prompt(message: Column, day: Column) -> Column:
    """A message with the day that it is of, which a model can't know."""
    name = F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(day) + 1)
    return F.concat(F.lit("Hôm nay là "), name, F.lit(", ngày "), F.date_format(day, "yyyy-MM-dd"), F.lit(".\nTin nhắn: "), F.coalesce(message, F.lit("")))


def trip_summary(origin: Column, destination: Column, vehicle: Column, cargo: Column, pickup: Column) -> Column:
    """One line on a trip; cargo and pickup only where they are known."""
    given = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(", ", F.concat(origin, F.lit(" → "), destination), F.concat(F.lit("xe "), vehicle), given(cargo), F.concat(F.lit("lấy hàng "), given(pickup)))
