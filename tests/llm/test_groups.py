import numpy as np
import pyarrow as pa

from loamtree.llm import substring_dedup as sd


def test_a_shard_is_streamed_by_itself():
    """One automaton is held at a time: a group is a shard's copy and its spans, in any order, or spans alone."""
    words = np.arange(80, dtype=np.int64)
    automaton = sd.SuffixAutomaton()
    automaton.add(words[:60].tolist(), 3)
    automaton.finish()
    span = lambda doc: {"shard": 1, "salt": 0, "reads": True, "doc_id": doc, "text_hash": 9, "start": 5, "symbols": words.tobytes()}
    schema = pa.schema([("shard", pa.int64()), ("salt", pa.int32()), *(f for f in sd._SPAN_SCHEMA if f.name != "shard"), *((c, pa.binary()) for c in sd.AUTOMATON)])
    own = {"shard": 1, "salt": 0, "reads": False} | automaton.flat()
    found = sd._streamed(pa.Table.from_pylist([span(7), own, span(2)], schema))
    assert [tuple(r.values())[:4] + (r["symbols"] is None,) for r in found.to_pylist()] == [(7, 9, 5, 16, True), (7, 9, 16, 36, False), (2, 9, 5, 36, False)]
    alone = sd._streamed(pa.Table.from_pylist([span(7)], schema)).to_pylist()
    assert [(r["start"], r["stop"], r["symbols"] == words.tobytes()) for r in alone] == [(5, 36, True)]
