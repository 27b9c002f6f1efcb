"""The shuffles of `ppm` leave nothing behind on disk and do not depend on their slices."""

from __future__ import annotations

import os
import zlib

from lumengraph.llm import ppm
from lumengraph.session import scratch, shared_dir


def files(folder: str) -> set[str]:
    return {os.path.join(at, name) for at, _, names in os.walk(folder) for name in names if name.startswith("part-")}


def test_slices_are_deleted_when_used(spark, monkeypatch):
    """Texts, leaves and costs are gone before the scores are read; each number of slices gives the same scores."""
    docs = spark.createDataFrame([(i, f"word{i % 7} and {zlib.crc32(b'%d' % i)} more " * (i % 5)) for i in range(200)], "doc_id long, text string")
    folder, found = f"{shared_dir(spark)}/lumengraph".removeprefix("file:"), []
    for slices in (4, 1):
        monkeypatch.setattr(ppm, "SLICES", slices)
        monkeypatch.setattr(ppm, "UNIT_BYTES", 500)
        monkeypatch.setattr(ppm, "PART_BYTES", 2000)
        before = files(folder)
        with scratch(spark):
            scored = ppm.score_documents(docs)
            assert not [f for f in files(folder) - before if "slice=" in f or "kind=" in f]
            found.append({r.doc_id: round(r.score, 6) for r in scored.collect()})
    assert found[0] == found[1] and len(found[0]) == 200
