"""Order-dependent merges of word lists: greedy by definition, so each label is a sequential scan in one group."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame

_OUT = "label_id long, place long, engine string, text string, cx double, cy double, conf double"


class _Kept:
    """Words in list order, found by the cells of a grid."""

    def __init__(self, near: float):
        self.near, self.words, self.cells = near, [], {}

    def _cell(self, word: list) -> tuple[int, int]:
        return int(word[2] // self.near), int(word[3] // self.near)

    def close(self, word: list) -> list[int]:
        x, y = self._cell(word)
        at = (i for a in (-1, 0, 1) for b in (-1, 0, 1) for i in self.cells.get((x + a, y + b), ()))
        return sorted(i for i in at if abs(self.words[i][2] - word[2]) < self.near and abs(self.words[i][3] - word[3]) < self.near)

    def add(self, word: list) -> None:
        self.cells.setdefault(self._cell(word), []).append(len(self.words))
        self.words.append(word)

    def replace(self, i: int, word: list) -> None:
        self.cells[self._cell(self.words[i])].remove(i)
        self.words[i] = word
        self.cells.setdefault(self._cell(word), []).append(i)


def merge_into(first: Iterable[list], more: Iterable[list], near: float, replace: bool) -> list[list]:
    """first as it is, then each further word: the first near entry in list order takes it, and is replaced by a surer one if `replace`."""
    kept = _Kept(near)
    for word in first:
        kept.add(word)
    for word in more:
        close = kept.close(word)
        if not close:
            kept.add(word)
        elif replace and word[4] > kept.words[close[0]][4]:
            kept.replace(close[0], word)
    return kept.words


def _rows(pdf: pd.DataFrame) -> list[list]:
    """Words as lists: engine, text, cx, cy, conf, and the zone where there is one."""
    columns = [pdf[c] for c in ("engine", "text", "cx", "cy", "conf", "zone") if c in pdf]
    return [list(r) for r in zip(*columns, strict=True)]


def _frame(label: int, words: list[list]) -> pd.DataFrame:
    out = pd.DataFrame([w[:5] for w in words], columns=["engine", "text", "cx", "cy", "conf"])
    out.insert(0, "place", range(len(out)))
    out.insert(0, "label_id", label)
    return out


def _greedy(pdf: pd.DataFrame, near: float, replace: bool) -> pd.DataFrame:
    pdf = pdf.sort_values(["rank", "word_idx"])
    return _frame(pdf.label_id.iloc[0], merge_into(_rows(pdf[pdf["rank"] == 0]), _rows(pdf[pdf["rank"] > 0]), near, replace))


def merged_words(words: DataFrame, near: float = 15.0) -> DataFrame:
    """words (label_id, engine, rank 0 first, word_idx, text, cx, cy, conf): the first list, then others' words merged in."""
    return words.groupBy("label_id").applyInPandas(lambda pdf: _greedy(pdf, near, True), _OUT)


def deduplicated(words: DataFrame, near: float = 20.0) -> DataFrame:
    """The first list wins; others' words stay only where nothing kept is near."""
    return words.groupBy("label_id").applyInPandas(lambda pdf: _greedy(pdf, near, False), _OUT)


#: The passes in their order.
PASSES = ("first", "whole", "zones", "strip", "second", "file")


def _in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("word_idx")
    of = {p: pdf[pdf["pass"] == p] for p in PASSES}
    main = len(of["whole"]) > 0
    words = _rows(of["first"])
    if main:
        words = merge_into(words, _rows(of["whole"]), 15.0, True) if words else _rows(of["whole"])
        counts = Counter(w[5] for w in words)
        zones = of["zones"]
        asked = zones[pd.Series([counts[z] < 3 and not z.endswith("copy_count") for z in zones.zone], zones.index, bool)]
        words = merge_into(words, _rows(asked), 15.0, True) + _rows(of["strip"])
        words = merge_into(words, _rows(of["second"]), 20.0, True)
    elif len(of["second"]):
        words = _rows(of["second"])
    exact = _rows(of["file"])
    if exact:
        words = exact + merge_into(exact, words, 20.0, False)[len(exact) :]
    return _frame(pdf.label_id.iloc[0], words)


def in_pass_order(words: DataFrame) -> DataFrame:
    """The words that all passes together give (label_id, pass, engine, word_idx, text, cx, cy, conf, zone).

    The main engine's scan of the whole label is merged into the first engine's words; zones with fewer than three words
    are asked again and merged, the copy count strip is added, the second engine is merged. Without a scan of the whole the
    second engine alone counts. Words of the file itself come first and drop others near them.
    """
    return words.groupBy("label_id").applyInPandas(_in_order, _OUT)
