"""Text functions as columns: words, extraction by expression, addresses, printable rendering."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What parts words: everything but letters and digits.
BREAK = r"[^\p{L}\p{N}]+"
HOST = r"(\w+)(\.\w+)+(:\d+)?"
URL = HOST + r"(/+\w+)+"
MAIL = r"(\w+)([.!\-_+]\w+)*@(\w+)([.!\-_+]\w+)*"
ADDRESS = r"([^@|\s]+@[^@\s]+\.[^@|\s]+)"


def words(text: Column) -> Column:
    """Words of a text in order, in lower case; null for null."""
    return F.filter(F.split(F.lower(text), BREAK), lambda w: w != "")


def words_py(text: str) -> list[str]:
    """The same on the driver, for a request's few words."""
    import regex

    return [w for w in regex.split(BREAK, text.lower()) if w]


def hosts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(HOST), F.lit(0))


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(URL), F.lit(0))


def mails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MAIL), F.lit(0))


def extracted(text: Column) -> Column:
    """Distinct hosts, addresses of pages and mail addresses of a text in lower case, as extra words."""
    t = F.lower(text)
    return F.array_distinct(F.concat(hosts(t), urls(t), mails(t)))


def address(header: Column) -> Column:
    """The first mail address of a header that has a domain with a dot, else null."""
    return F.nullif(F.regexp_extract(F.regexp_replace(header, "[<>\",]", " "), ADDRESS, 1), F.lit(""))


def address_py(header: str) -> str | None:
    from email.utils import parseaddr

    found = parseaddr(header)[1]
    m = re.match(ADDRESS, found) if found else None
    return m[1] if m else None


def printable(text: Column) -> Column:
    """Everything outside printable ASCII as a dot."""
    return F.regexp_replace(text, r"[^\x20-\x7e]", ".")


def decoded(data: Column, charset: str = "UTF-8") -> Column:
    """Bytes in a known charset as text; bytes that aren't valid are replaced."""
    return F.decode(data, charset)


def key_name(bucket: Column, key: Column) -> Column:
    """A fixed-length name for a key of a bucket."""
    return F.sha2(F.concat_ws(":", bucket, key), 256)
