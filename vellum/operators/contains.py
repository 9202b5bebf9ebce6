"""Which names occur in some text: the names go to the texts, not the texts to the names."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame


def _finder(names: list[str]):
    """mapInArrow body: texts to the names that occur in them, each once for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, missing = ahocorasick.Automaton(), set(names)
        for n in names:
            auto.add_word(n, n)
        auto.make_automaton()
        for batch in batches:
            if not missing:
                continue
            for text in batch.column(0).to_pylist():
                if text:
                    missing.difference_update(n for _, n in auto.iter(text))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(set(names) - missing), pa.string())], names=["name"])

    return run


def occurring(names: DataFrame, texts: DataFrame, at_once: int = 100_000) -> DataFrame:
    """name: those of the first column that is called name whose text occurs in some text of texts, a table of one column.

    The texts are read once for each `at_once` names, by one automaton of them a task,
    and are neither moved nor joined.  Null and empty names occur nowhere.
    """
    wanted = names.select("name").where("name <> ''").distinct()
    parts, group = [], []
    for r in wanted.orderBy("name").toLocalIterator():
        group.append(r["name"])
        if len(group) == at_once:
            parts.append(texts.mapInArrow(_finder(group), "name string"))
            group = []
    parts.append(texts.mapInArrow(_finder(group), "name string"))
    return reduce(DataFrame.unionAll, parts).distinct()
