from __future__ import annotations

import datetime as dt

import numpy as np

from graphloom.operators.references import RANGE, bits_of, container, orphan_references, orphan_report

T = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)

ENT = "graph string, id string, created_at timestamp, removed_at timestamp"
MOD = "target_id string, added_at timestamp, removed_at timestamp"
REL = "rel_id long, graph string, source_id string, target_id string, created_at timestamp"


def found(frame, rels, ents, mods=(), **kw):
    df = orphan_references(frame(list(rels), REL), frame(list(ents), ENT), frame(list(mods), MOD), **kw)
    return sorted((r.rel_id, r.side, r.reason) for r in df.collect())


def test_reasons(frame):
    ents = [("g", "a", T(0), None), ("g", "b", T(10), T(20)), ("g", "b", T(40), None), ("h", "a", T(0), None), ("g", "old", T(0), T(5))]
    mods = [("external:m", T(3), T(30)), ("external:m", T(50), None)]
    rels = [
        (1, "g", " A\t", "a", T(1)), (2, "g", "b", "B", T(5)), (3, "g", "b", "b", T(15)), (4, "g", "b", "a", T(20)), (5, "g", "b", "b", T(30)), (6, "g", "b", "b", T(40)),
        (7, "h", "b", "a", T(1)), (8, "g", None, "  ", T(1)), (9, "g", "external:M", "external:m", T(1)), (10, "h", "external:m", "external:m", T(35)), (11, "g", "old", "a", T(6)),
        (12, "g", "a", "external:m", T(50)),
    ]
    assert found(frame, rels, ents, mods) == [
        (2, "source", "late"), (2, "target", "late"), (4, "source", "deleted"), (5, "source", "deleted"), (5, "target", "deleted"), (7, "source", "missing"),
        (8, "source", "missing"), (8, "target", "missing"), (9, "source", "late"), (9, "target", "late"), (10, "source", "deleted"), (10, "target", "deleted"), (11, "source", "deleted"),
    ]


def test_brute_force_on_a_grid(frame):
    ents = [("g", f"k{i % 17}", T(i * 3 % 40), T(i * 3 % 40 + i % 9 + 1) if i % 3 else None) for i in range(60)]
    rels = [(i, "g", f"K{i % 19}", f"k{i * 7 % 23}", T(i % 50)) for i in range(400)]
    want = []
    for rel, _, s, t, at in rels:
        for side, ref in (("source", s), ("target", t)):
            lives = [(b, d) for _, k, b, d in ents if k == ref.lower()]
            if not any(b <= at and (d is None or d > at) for b, d in lives):
                want.append((rel, side, "missing" if not lives else "late" if all(b > at for b, _ in lives) else "deleted"))
    assert found(frame, rels, ents) == sorted(want)
    assert found(frame, rels, ents, hot_rows=1) == sorted(want)


def test_containers_hold_every_bit():
    rng = np.random.default_rng(3)
    spans = np.zeros(RANGE, np.uint8)
    spans[5:900] = spans[20_000:] = 1
    for bits, kind in ((np.zeros(RANGE, np.uint8), b"p"), (np.ones(RANGE, np.uint8), b"r"), (spans, b"r"), ((rng.random(RANGE) < 0.001).astype(np.uint8), b"p"), ((rng.random(RANGE) < 0.5).astype(np.uint8), b"b")):
        packed = container(np.packbits(bits, bitorder="little").tobytes())
        assert packed[:1] == kind and len(packed) <= RANGE // 8 + 1 and (bits_of(packed) == bits).all()


def test_repeated_rows_nulls_and_empty_tables(frame):
    rels = [(1, "g", "a", "x" * 5000, T(1)), (1, "g", "a", "x" * 5000, T(1)), (2, None, "a", "a", T(1)), (3, "g", "a", "a", None)]
    ents = [("g", "a", T(0), None), ("g", "a", T(0), None), ("g", None, T(0), None), (None, "a", T(0), None)]
    assert found(frame, rels, ents) == [(1, "target", "missing"), (2, "source", "missing"), (2, "target", "missing"), (3, "source", "deleted"), (3, "target", "deleted")]
    assert found(frame, [], ents) == []
    assert found(frame, rels[:1], []) == [(1, "source", "missing"), (1, "target", "missing")]


def test_report(frame):
    df = orphan_references(frame([(1, "g", "a", "b", T(1)), (2, "g", "a", "b", T(40))], REL), frame([], ENT), frame([], MOD))
    assert sorted(tuple(r) for r in orphan_report(df).collect()) == [
        ("relationships.source_id", "2024-01", "missing", 1), ("relationships.source_id", "2024-02", "missing", 1), ("relationships.target_id", "2024-01", "missing", 1), ("relationships.target_id", "2024-02", "missing", 1)
    ]
