"""The request model: a boolean tree of search parts with boosts, filter, facets and paging, to and from JSON.

Unknown keys are ignored, so requests written for newer versions still load.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any

from .errors import InvalidRequest

BOOST_FUNCTIONS = ("Log10", "Log2", "Multiply", "Add", "Replace")


@dataclass(frozen=True)
class Boost:
    path: str
    boost_fun: str | None = None
    param: float | None = None
    skip_when_score: tuple[float, ...] = ()
    expression: str | None = None

    def __post_init__(self) -> None:
        if self.boost_fun is not None and self.boost_fun not in BOOST_FUNCTIONS:
            raise InvalidRequest(f"unknown boost function {self.boost_fun!r}")


@dataclass(frozen=True)
class Options:
    explain: bool = False
    top: int | None = None
    skip: int | None = None
    boost: tuple[Boost, ...] = ()


@dataclass(frozen=True)
class SnippetInfo:
    num_words_around_snippet: int = 5
    snippet_start_tag: str = "<b>"
    snippet_end_tag: str = "</b>"
    snippet_connector: str = " ... "
    max_snippets: int = 2**32


@dataclass(frozen=True)
class Part:
    path: str
    terms: tuple[str, ...]
    levenshtein_distance: int | None = None
    starts_with: bool = False
    is_regex: bool = False
    token_value: Boost | None = None
    boost: float | None = None
    ignore_case: bool | None = None
    snippet: bool = False
    snippet_info: SnippetInfo | None = None
    top: int | None = None
    skip: int | None = None
    options: Options | None = None

    def __post_init__(self) -> None:
        if not self.terms:
            raise InvalidRequest("a search part needs a term")

    @property
    def term(self) -> str:
        return self.terms[0]


@dataclass(frozen=True)
class Tree:
    operator: str  # or, and
    queries: tuple[Node, ...]
    options: Options | None = None


Node = Part | Tree


@dataclass(frozen=True)
class Facet:
    field: str
    top: int | None = 10


@dataclass(frozen=True)
class PhraseBoost:
    search1: Part
    search2: Part


@dataclass(frozen=True)
class Request:
    search_req: Node | None = None
    suggest: tuple[Part, ...] | None = None
    boost: tuple[Boost, ...] = ()
    boost_term: tuple[Part, ...] = ()
    facets: tuple[Facet, ...] = ()
    phrase_boosts: tuple[PhraseBoost, ...] = ()
    select: tuple[str, ...] | None = None
    filter: Node | None = None
    top: int | None = None
    skip: int | None = None
    why_found: bool = False
    text_locality: bool = False
    explain: bool = False


def _known(kind: type, raw: Mapping[str, Any], **made: Any) -> Any:
    names = {f.name for f in fields(kind)}
    given = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in names and v is not None and k not in made}
    try:
        return kind(**given, **{k: v for k, v in made.items() if v is not None})
    except TypeError as e:
        raise InvalidRequest(str(e)) from e


def boosts_from_json(raw: Any) -> tuple[Boost, ...] | None:
    return None if raw is None else tuple(_known(Boost, x) for x in (raw if isinstance(raw, list) else [raw]))


def _options(raw: Any) -> Options | None:
    return _known(Options, raw, boost=boosts_from_json(raw.get("boost"))) if raw else None


def part_from_json(raw: Mapping[str, Any]) -> Part:
    value = raw.get("token_value")
    info = raw.get("snippet_info")
    return _known(
        Part, raw, token_value=_known(Boost, value) if value else None, snippet_info=_known(SnippetInfo, info) if info else None, options=_options(raw.get("options"))
    )


def node_from_json(raw: Mapping[str, Any]) -> Node:
    for operator in ("or", "and"):
        if operator in raw:
            inner = raw[operator]
            return Tree(operator, tuple(node_from_json(q) for q in inner["queries"]), _options(inner.get("options")))
    if "search" in raw:
        return part_from_json(raw["search"])
    raise InvalidRequest("a search node is one of or, and, search")


def from_json(raw: str | Mapping[str, Any]) -> Request:
    """A request from its JSON text or the parsed object."""
    if isinstance(raw, str):
        try:
            raw = json.loads(raw)
        except ValueError as e:
            raise InvalidRequest(f"not JSON: {e}") from e
    parts = lambda name: tuple(part_from_json(x) for x in raw[name]) if raw.get(name) is not None else None
    phrases = raw.get("phrase_boosts")
    # a bare tree is a request of its own
    tree = raw.get("search_req") or (raw if any(k in raw for k in ("search", "or", "and")) else None)
    return _known(
        Request,
        raw,
        search_req=node_from_json(tree) if tree else None,
        suggest=parts("suggest"),
        boost=boosts_from_json(raw.get("boost")),
        boost_term=parts("boost_term"),
        facets=tuple(_known(Facet, x) for x in raw["facets"]) if raw.get("facets") else None,
        phrase_boosts=tuple(PhraseBoost(part_from_json(x["search1"]), part_from_json(x["search2"])) for x in phrases) if phrases else None,
        filter=node_from_json(raw["filter"]) if raw.get("filter") else None,
    )


def simplify(node: Node) -> Node:
    """Pull up an OR inside an OR and an AND inside an AND, unless the inner one has options.

    This changes scores, since OR doesn't associate; children pulled up come last.
    """
    if isinstance(node, Part):
        return node
    queries = [simplify(q) for q in node.queries]
    merges = lambda q: isinstance(q, Tree) and q.operator == node.operator and q.options is None
    lifted = [x for q in reversed(queries) if merges(q) for x in q.queries]
    return replace(node, queries=tuple([q for q in queries if not merges(q)] + lifted))


def parts(node: Node) -> list[Part]:
    """All search parts of a tree, in order."""
    return [node] if isinstance(node, Part) else [p for q in node.queries for p in parts(q)]


def term_key(node: Node) -> str:
    """The term under which a child of an OR is counted: that of its first part."""
    return node.term if isinstance(node, Part) else term_key(node.queries[0]) if node.queries else ""


@dataclass(frozen=True)
class SearchParams:
    """Convenience parameters from which a request is generated."""

    search_term: str = ""
    parser_options: Any = None
    top: int | None = None
    skip: int | None = None
    ignore_case: bool | None = None
    operator: str | None = None
    levenshtein: int | None = None
    levenshtein_auto_limit: int | None = None
    facetlimit: int | None = None
    why_found: bool | None = None
    text_locality: bool | None = None
    boost_queries: tuple[Boost, ...] | None = None
    facets: tuple[str, ...] | None = None
    stopword_lists: tuple[str, ...] | None = None
    stopwords: frozenset[str] | None = None
    fields: tuple[str, ...] | None = None
    boost_fields: Mapping[str, float] | None = None
    boost_terms: Mapping[str, float] | None = None
    phrase_pairs: bool | None = None
    explain: bool | None = None
    filter: str | None = None
    filter_parser_options: Any = None
    select: tuple[str, ...] | None = None


@dataclass(frozen=True)
class FieldInfo:
    """What the generator needs to know of an index."""

    all_fields: list[str] = field(default_factory=list)
    searchable: list[str] = field(default_factory=list)
