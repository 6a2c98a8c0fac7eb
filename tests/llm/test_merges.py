"""The merge of posting lists: what it goes through grows with its postings, not with the runs they come in."""

from collections import Counter

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.llm import divergence


def _batches(rows, size):
    kinds = to_arrow_schema(divergence.RUNS)
    for i in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + size]), kinds)], schema=kinds)


def test_runs_over_the_same_terms_are_not_gone_through_for_each_row(monkeypatch):
    monkeypatch.setattr(divergence, "STRETCH", 100)
    calls, before = [], divergence.Merge.before
    monkeypatch.setattr(divergence.Merge, "before", lambda self, term: calls.append(term) or before(self, term))
    rows, want = [], Counter()
    for shard in (0, 1):
        for run in range(400):  # each reaches from its own first term to the last one
            found = sorted({(f"{(run * 7 + i * i) % 30 + 30 * shard:03d}".encode(), f"s{(run + i) % 4}") for i in range(10)} | {(b"999", "s0")})
            terms, sources = zip(*found)
            rows.append((shard, "en", terms[0], terms, sources, [run + 1] * len(found), [1] * len(found)))
            want.update({(shard, t.decode(), s): run + 1 for t, s in found})
    rows.sort(key=lambda r: (r[0], r[2]))
    got = [r for b in divergence.posting_lists(1)(_batches(rows, 150)) for r in b.to_pylist()]
    of = lambda term: 0 if term < "030" else 1
    assert len(calls) <= 150
    assert Counter({(of(r["term"]), r["term"], s): n for r in got if r["term"] != "999" for s, n in zip(r["sources"], r["counts"])}) == Counter(
        {k: n for k, n in want.items() if k[1] != "999"})
    assert [r["counts"] for r in got if r["term"] == "999"] == [[400 * 401 // 2]] * 2
