"""Snippets: hits in a text with some words around them."""

from __future__ import annotations

from collections.abc import Collection

from ..plans.request import SnippetInfo
from .text import split_tokens


def snippet(tokens: list[str], hits: list[int], info: SnippetInfo = SnippetInfo()) -> str:
    """Windows around the hit positions, tagged and joined; hits close to each other share a window."""
    reach = 2 * info.num_words_around_snippet
    groups: list[list[int]] = []
    for at in sorted(hits):
        if groups and at - groups[-1][-1] < reach:
            groups[-1].append(at)
        else:
            groups.append([at])
    shown, marked = [], set(hits)
    for group in groups[: info.max_snippets]:
        lo, hi = max(0, group[0] - reach), min(len(tokens), group[-1] + reach + 1)
        shown.append("".join(f"{info.snippet_start_tag}{t}{info.snippet_end_tag}" if i in marked else t for i, t in enumerate(tokens[lo:hi], lo)))
    out = info.snippet_connector.join(shown)
    if groups and groups[0][0] > reach:
        out = info.snippet_connector + out
    if groups and groups[-1][-1] < len(tokens) - reach:
        out += info.snippet_connector
    return out


def highlight_text(text: str, wanted: Collection[str], info: SnippetInfo = SnippetInfo(), chars: str | None = None, tokenize: bool = True) -> str | None:
    """A snippet of ``text``, or None if no wanted term is in it. Tokens are compared as they are."""
    if len(wanted) == 1 and text in wanted:
        return f"{info.snippet_start_tag}{text}{info.snippet_end_tag}"
    if not tokenize:
        return None
    tokens = split_tokens(text, chars)
    hits = [i for i, t in enumerate(tokens) if t in wanted]
    if hits:
        return snippet(tokens, hits, info)
    return f"{info.snippet_start_tag}{text}{info.snippet_end_tag}" if text in wanted else None
