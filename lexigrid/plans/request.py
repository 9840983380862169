"""Search requests, their cookies, and the words of a command line."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from lexigrid.functions.text import words_py


class BadRequest(ValueError):
    """A request that can't be answered; over HTTP this would be status 400."""


@dataclass(frozen=True)
class Cookie:
    """Where the next page begins: the packed timestamp and id of its first document, inclusive."""

    ts: int
    id: str

    def __str__(self) -> str:
        return f"{self.ts}:{self.id}"

    @classmethod
    def parse(cls, text: str) -> Cookie | None:
        """None for an empty cookie."""
        if not text:
            return None
        ts, colon, id_ = text.partition(":")
        if not colon or not ts.lstrip("-").isdigit():
            raise BadRequest(f"not a cookie: {text!r}")
        return cls(int(ts), id_)


@dataclass(frozen=True)
class Terms:
    """What a query asks for. lists: distinct (attribute, term) in order of first appearance, a list of postings each.
    ivec: for each attribute the local ranks of its words, repeated ones included."""

    lists: tuple[tuple[str, str], ...]
    ivec: dict[str, tuple[int, ...]]

    @classmethod
    def of(cls, query: dict[str, str], split: Callable[[str], list[str]] = words_py, compat_ivec: bool = False) -> Terms:
        """compat_ivec: a first appearance stands by its position among the words and a repeated one by its place among all
        lists, which mixes two scales; else both stand by the local rank. Attributes without words are left out."""
        lists: dict[tuple[str, str], int] = {}
        ivec: dict[str, tuple[int, ...]] = {}
        for attr, text in query.items():
            local: dict[str, int] = {}
            vector = []
            for position, word in enumerate(split(text)):
                if (attr, word) in lists:
                    vector.append(lists[attr, word] if compat_ivec else local[word])
                    continue
                local[word] = len(local)
                lists[attr, word] = len(lists)
                vector.append(position if compat_ivec else local[word])
            if vector:
                ivec[attr] = tuple(vector)
        return cls(tuple(lists), ivec)

    def local_rank(self) -> dict[tuple[str, str], int]:
        seen: dict[str, int] = {}
        out = {}
        for attr, term in self.lists:
            out[attr, term] = seen.get(attr, 0)
            seen[attr] = seen.get(attr, 0) + 1
        return out


@dataclass(frozen=True)
class SearchRequest:
    """num None: no limit. match: accepted; "phrase" has an effect only where the caller asks for that extension.
    compat_ivec: see Terms.of. combine: how several attributes make one relevance, None for the engine's way. Both are
    extensions that a JSON request may carry under "ranking"."""

    mailbox: str
    query: dict[str, str]
    num: int | None = None
    start: str = ""
    match: str | None = None
    compat_ivec: bool = False
    combine: str | None = None
    terms: Terms = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "terms", self.words_by(words_py))

    def words_by(self, split: Callable[[str], list[str]]) -> Terms:
        return Terms.of(self.query, split, self.compat_ivec)

    def at(self, start: str) -> SearchRequest:
        """The same request from another cookie on."""
        return replace(self, start=start)

    @property
    def cookie(self) -> Cookie | None:
        return Cookie.parse(self.start)

    @classmethod
    def from_json(cls, text: str) -> SearchRequest:
        """Members of another type than expected count as missing; a missing mailbox or query is a BadRequest."""
        try:
            raw = json.loads(text)
        except ValueError as e:
            raise BadRequest(f"not JSON: {e}") from e
        if not isinstance(raw, dict):
            raise BadRequest("a request is an object")
        mailbox, query = raw.get("mailbox"), raw.get("query")
        if not isinstance(mailbox, str):
            raise BadRequest("'mailbox' must be a string")
        if not isinstance(query, dict):
            raise BadRequest("'query' must be an object")
        paging = raw["paging"] if isinstance(raw.get("paging"), dict) else {}
        match = raw["match"] if isinstance(raw.get("match"), dict) else {}
        number = paging.get("num")
        ranking = raw["ranking"] if isinstance(raw.get("ranking"), dict) else {}
        return cls(
            mailbox,
            {k: v for k, v in query.items() if isinstance(v, str)},
            number if isinstance(number, int) and not isinstance(number, bool) and number >= 0 else None,
            paging["start"] if isinstance(paging.get("start"), str) else "",
            match["type"] if isinstance(match.get("type"), str) else None,
            ranking.get("compat_ivec") is True,
            ranking["combine"] if ranking.get("combine") in ("last", "max", "mean") else None,
        )

    def to_json(self) -> str:
        out: dict = {"mailbox": self.mailbox, "query": self.query}
        if self.num is not None or self.start:
            out["paging"] = ({"num": self.num} if self.num is not None else {}) | ({"start": self.start} if self.start else {})
        ranking = ({"compat_ivec": True} if self.compat_ivec else {}) | ({"combine": self.combine} if self.combine else {})
        return json.dumps(out | ({"match": {"type": self.match}} if self.match else {}) | ({"ranking": ranking} if ranking else {}), ensure_ascii=False)


def attributes(pairs: list[str], text: str = "", default: str = "text") -> dict[str, str]:
    """"name:value" strings as a mapping, parted at the first colon; strings without one are ignored, of equal names the
    greatest value counts. text goes under `default`."""
    out: dict[str, str] = {}
    for p in pairs:
        name, colon, value = p.partition(":")
        if colon and value >= out.get(name, ""):
            out[name] = value
    return out | ({default: text} if text else {})


def parse_command(line: str, default: str = "text", prefix: str = "attr:") -> dict[str, str]:
    """A query typed by a user: words prefixed by "attr:" are name:value pairs, the others the text searched for."""
    pairs, plain = [], []
    for word in line.split():
        if word.startswith(prefix):
            pairs.append(word[len(prefix) :])
        else:
            plain.append(word)
    return attributes(pairs, " ".join(plain), default)
