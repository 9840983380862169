"""Words of HTML pages and of mails, as a client would send them to be indexed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from email import message_from_bytes
from email.header import decode_header
from email.message import Message
from email.utils import mktime_tz, parsedate_tz
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.text import HOST, MAIL, URL, address_py
from lexigrid.functions.timestamps import pack
from lexigrid.schema import VALUES

#: Pages whose words a worker holds at once.
_PAGES = 64
_EXTRA = [re.compile(p) for p in (HOST, URL, MAIL)]


#: Letters of the languages of a single-byte charset, the most frequent first. A text of which over 60 % of the letters are beyond
#: ASCII is in one of the first three, else in one of the others.
_LETTERS = {
    "cp1251": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъёОЕАИНТСРВЛКМДПУЯГЗБЧХЖШЮЭ",
    "koi8-r": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъёОЕАИНТСРВЛКМДПУЯГЗБЧХЖШЮЭ",
    "cp1253": "αοιετσνηυρπκμλωςγδχθφβξζψάέήίόύώϊΑΟΙΕΤΣΝΗΥΡΠΚΜΛΩΞ",
    "cp1252": "äöüßéèêàâçîïôûùñáíóúøåæœÄÖÜÉÀÑ’‘“”–—€",
    "cp1250": "ąćęłńóśźżěščřžýáíéůďťňőűöüÁČŠŽŁŻŹĆŚ",
}
_WEIGHTS = {c: {x.encode(c)[0]: 1 - i / len(letters) for i, x in enumerate(letters)} for c, letters in _LETTERS.items()}
_LATIN = ("cp1252", "cp1250")
_MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))


def detect(data: bytes) -> str | None:
    """The charset that bytes are probably in, None for binary data: by a byte order mark, as UTF-8 if they are valid, as UTF-16 if
    every other byte is zero, else the single-byte charset whose frequent letters its high bytes are, Windows-1252 if none."""
    for mark, charset in _MARKS:
        if data.startswith(mark):
            return charset
    if zeros := data.count(0):
        even, odd = data[::2].count(0), data[1::2].count(0)
        if zeros * 5 > len(data) * 2 and min(even, odd) * 20 <= zeros:
            return "utf-16-be" if even > odd else "utf-16-le"
        return None
    try:
        data.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        high = [b for b in data if b >= 0x80]
        low = sum(chr(b).isalpha() for b in data if b < 0x80)
        latin = len(high) < 4 or len(high) * 2 < 3 * low
        score = {c: sum(own.get(b, -1.0) for b in high) for c, own in _WEIGHTS.items() if (c in _LATIN) == latin}
        if latin:  # the accents of one are letters of the other: how many there are counts, not which
            score = {c: sum(b in _WEIGHTS[c] for b in high) for c in _LATIN}
        return max(score, key=score.get)


def recode(data: bytes | str | None, charset: str | None = None) -> str:
    """Bytes as text: by the charset named, else the one detected; binary data gives nothing."""
    if data is None or isinstance(data, str):
        return data or ""
    if not charset or charset == "unknown-8bit":
        found = detect(data)
        return data.decode(found, "ignore") if found else ""
    if charset == "binary":
        return ""
    try:
        return data.decode(charset)
    except (LookupError, UnicodeDecodeError):
        return data.decode("utf-8", "ignore")


class Words(HTMLParser):
    """The set of a page's tag names, attribute values and texts in lower case, and the hosts and addresses within them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: set[str] = set()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for _, v in attrs:
            self.handle_data(v or "")
        self.handle_data(tag)

    def handle_data(self, data: str) -> None:
        text = data.lower()
        if text:
            self.found.add(text)
            for p in _EXTRA:
                self.found.update(m[0] for m in p.finditer(text))


def html_words(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """(id, word): the distinct words of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, _PAGES) for b in batches for at in range(0, b.num_rows, _PAGES)):
            ids, words = [], []
            for i, page in zip(batch.column("id"), batch.column("html")):  # one page's text as a Python object at a time
                parser = Words()
                parser.feed(page.as_py() or "")
                parser.close()
                ids += [i.as_py()] * len(parser.found)
                words += sorted(parser.found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(words, pa.string())], ["id", "word"])

    return pages.selectExpr(f"CAST(`{id_column}` AS STRING) AS id", f"`{html_column}` AS html").mapInArrow(run, "id string, word string")


def header_parts(header: str | None) -> list[str]:
    """A header's parts as text, encoded words decoded."""
    out = []
    for part, charset in decode_header(header) if header else []:
        out.append(part if isinstance(part, str) else recode(part, charset))
    return out


def _address(parts: list[str]) -> str | None:
    return next((a for a in map(address_py, parts) if a), None)


def parse_mail(data: bytes, mailbox: str | None = None, id: str | None = None) -> dict | None:  # noqa: A002
    """A mail as mailbox, id, ts in seconds, words and attributes ("from", "to").

    The mailbox defaults to the address in To, the id to that in Message-Id; None if either is unknown."""
    mail: Message = message_from_bytes(data)
    parser = Words()
    attrs: dict[str, str] = {}

    def address_header(name: str, attr: str) -> str | None:
        parts = header_parts(mail.get(name))
        parser.found.update(parts)
        a = _address(parts)
        if a and a >= attrs.get(attr, ""):  # of several the greatest, so that the choice is fixed
            attrs[attr] = a
        return a

    parser.found.update(header_parts(mail.get("Subject")))
    for name, attr in (("Cc", "to"), ("Bcc", "to"), ("From", "from")):
        address_header(name, attr)
    to = address_header("To", "to")
    date = parsedate_tz(mail.get("Date") or "")
    mailbox, id = mailbox or to, id or _address([mail.get("Message-Id") or ""])  # noqa: A001
    if not mailbox or not id:
        return None
    for part in mail.walk():
        if not part.is_multipart():
            parser.feed(recode(part.get_payload(decode=True), part.get_content_charset()))
    parser.close()
    return {"mailbox": mailbox, "id": id, "tsec": int(mktime_tz(date)) if date else None, "words": sorted(parser.found), "attrs": attrs}


MAIL_SCHEMA = "path string, mailbox string, id string, tsec bigint, words array<string>, attrs map<string,string>"


def mails(files: DataFrame, mailbox: str | None = None) -> DataFrame:
    """files (path, content), as read by binaryFile -> a row a mail; those without mailbox or id are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, parse_mail(bytes(c), mailbox)) for p, c in zip(pdf["path"], pdf["content"])]
            rows = [{"path": p, **m} for p, m in rows if m]
            out = pd.DataFrame(rows, columns=["path", "mailbox", "id", "tsec", "words", "attrs"], dtype=object)
            yield out

    return files.select("path", "content").mapInPandas(run, MAIL_SCHEMA)


def mail_values(mails: DataFrame, bucket: str = "mail", now: int | None = None) -> DataFrame:
    """Rows of mails() -> schema.VALUES, to be indexed: the words as attribute "text", which is a set, so that positions in it mean
    nothing, and the addresses as "from" and "to". The key is the file's path; a mail without a date is of now."""
    sec = F.unix_seconds(F.current_timestamp()) if now is None else F.lit(now)
    text = F.map_from_arrays(F.array(F.lit("text")), F.array(F.array_join("words", " ")))
    each = mails.select("mailbox", "id", F.lit(bucket).alias("bucket"), F.col("path").alias("key"), pack(F.coalesce("tsec", sec), F.lit(0)).alias("ts"), F.explode(F.map_concat("attrs", text)).alias("attr", "value"))
    return each.to(VALUES)


def html_values(words: DataFrame, mailbox: str, bucket: str = "html", now: int | None = None) -> DataFrame:
    """Rows of html_words() -> schema.VALUES, to be indexed: a page's words as attribute "text"."""
    sec = F.unix_seconds(F.current_timestamp()) if now is None else F.lit(now)
    pages = words.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("word")), " ").alias("value"))
    return pages.select(F.lit(mailbox).alias("mailbox"), "id", F.lit(bucket).alias("bucket"), F.col("id").alias("key"), pack(sec, F.lit(0)).alias("ts"), F.lit("text").alias("attr"), "value").to(VALUES)
