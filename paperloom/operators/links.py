"""Paper ids in answers as labelled links, all ids of an answer in one pass over its text.

The ids of an answer's papers become one automaton, which finds all their places at once, however many
there are. Of places that overlap the longest id's counts (then the smaller id's, then the earlier one),
and places of one id with only white space between them are one link. This is what
``functions.answers.linkify`` says with one pass per paper.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def link_places(text: str, ids: list[str]) -> list[tuple[int, int, str]]:
    """(start, end, id) of the links of a text, in its order."""
    automaton = ahocorasick.Automaton()
    for i in ids:
        if i:
            automaton.add_word(i, i)
    if not len(automaton):
        return []
    automaton.make_automaton()
    found = [(end + 1 - len(i), end + 1, i) for end, i in automaton.iter(text)]
    taken, chosen = bytearray(len(text)), []
    for start, end, i in sorted(found, key=lambda f: (-len(f[2]), f[2], f[0])):
        if not any(taken[start:end]):
            taken[start:end] = b"\1" * (end - start)
            chosen.append((start, end, i))
    links: list[tuple[int, int, str]] = []
    for start, end, i in sorted(chosen):
        if links and links[-1][2] == i and not text[links[-1][1] : start].strip(" \t\n\x0b\f\r"):
            links[-1] = (links[-1][0], end, i)
        else:
            links.append((start, end, i))
    return links


def _linked(text: str | None, papers: list[dict] | None) -> str | None:
    if text is None or papers is None:
        return None
    labels = {}
    for p in sorted(papers, key=lambda p: str(p["paperId"])):
        if p["paperId"] is not None and p["label"] is not None:
            labels.setdefault(p["paperId"], p["label"])
    out, at = [], 0
    for start, end, i in link_places(text, list(labels)):
        out += [text[at:start], f"[{labels[i]}](#{i})"]
        at = end
    return "".join([*out, text[at:]])


def linkify_texts(answers: DataFrame, text: Column, papers: Column, name: str = "linked") -> DataFrame:
    """Adds ``name``: the text with the ids of ``papers``, an array of (paperId, label), as links.

    A null text or list gives null; a paper without id or label makes no link.
    """
    rows = answers.select("*", text.alias("_text"), papers.alias("_papers"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in answers.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [_linked(t, p) for t, p in zip(batch.column("_text").to_pylist(), batch.column("_papers").to_pylist())]
            kept = [c for c in batch.schema.names if c not in ("_text", "_papers")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(linked, pa.string())], names=[*kept, name])

    return rows.mapInArrow(run, f"{fields}, `{name}` string")
