"""The un-refined annotation against a plain rendering of its rules, a sequence at a time."""

import random

from tandemlake.functions.kmers import canonical
from tandemlake.plans.annotate import raw_spans
from tandemlake.plans.params import Params

P = Params(k=8, window=40, band=400, identity=80.0)


def cells_of(values, first, length):
    """Scores of one band's windows; values by position, the band's own positions first to first + length, and what it borrows."""
    m, h, w = P.windows, P.interval, P.window
    kept = {p - first: int(v) for p, v in enumerate(values) if first <= p < first + P.band + h and v % 4 == 0 and v != 0}
    plain = [{v for p, v in kept.items() if i * w <= p < (i + 1) * w} for i in range(m)]
    wide = [{v for p, v in kept.items() if max(0, i * w - h) <= p < (i + 1) * w + h} for i in range(m)]
    out = set()
    for i in range(m):
        for j in range(i):
            if plain[i] and plain[j]:
                share = max(len(plain[i] & wide[j]) / len(plain[i]), len(plain[j] & wide[i]) / len(plain[j]))
                if 100 * share ** (1 / P.k) >= P.identity:
                    out |= {(i, j), (j, i)}
    return out


def spans_of(near):
    found = {}
    for i in range(P.windows):
        ends = []
        for step in (-1, 1):
            at, last, misses = i + step, i, 0
            while 0 <= at < P.windows and misses < P.tolerance:
                last, misses = (at, 0) if (i, at) in near else (last, misses + 1)
                at += step
            ends.append(last)
        found.setdefault(tuple(ends), []).append(i)
    return sorted((a, rows[0], z) for (a, z), rows in found.items() if len(rows) >= 3)


def by_hand(seq):
    values, kept, w = canonical(seq.encode(), P.k), [], P.window
    for band in range(len(values) // P.band + 1):
        base, clear = band * P.band, []
        for a, _, z in spans_of(cells_of(values, base, P.band)):
            a, z = base + a * w, base + (z + 1) * w
            if not any(abs(x - a) <= w or abs(y - z) <= w or (x < a and y > z) for x, y in clear):
                clear.append((a, z))
        kept += [(a, z) for a, z in clear if not any(a == x or z == y for x, y in kept)]
    out = []
    for a, z in sorted(kept):
        edge = out and (out[-1][1] % P.band <= 3 * w or out[-1][1] % P.band >= P.band - 3 * w)
        if edge and not out[-1][2] and abs(out[-1][1] - a) <= 4 * w:
            out[-1] = (out[-1][0], max(z, out[-1][1]), True)
        else:
            out.append((a, z, False))
    return sorted((a, min(z, len(seq))) for a, z, _ in out if a < min(z, len(seq)))


def test_raw_spans(spark):
    r = random.Random(11)
    seqs = {}
    for n in range(12):
        parts = []
        for _ in range(r.randrange(2, 6)):
            parts.append("".join(r.choice("ACGT") for _ in range(r.randrange(60, 400))))
            monomer = "".join(r.choice("ACGT") for _ in range(r.randrange(5, 60)))
            array = [r.choice("ACGT") if r.random() < 0.01 else c for c in monomer * 40][: r.randrange(100, 700)]
            parts.append("".join(array))
        seqs[f"s{n}"] = "".join(parts)
    got: dict = {}
    for x in raw_spans(spark.createDataFrame(list(seqs.items()), "seq_id string, seq string"), P).collect():
        got.setdefault(x.seq_id, []).append((x.start, x.end))
    want = {n: by_hand(s) for n, s in seqs.items()}
    assert {n: sorted(got.get(n, [])) for n in seqs} == want and sum(map(len, want.values())) > 12
