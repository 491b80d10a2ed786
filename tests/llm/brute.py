"""Plain single-process versions of the pipeline's stages."""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections import Counter, defaultdict

import regex
import xxhash

from memlake.llm import line_dedup as ld, mixing as mx
from memlake.llm.quality import STOP_WORDS

WORD = r"[^\x20\x09-\x0D]+"


def quality(text):
    text = text or ""
    w = re.findall(WORD, text)
    n = len(w)
    g = [tuple(w[i : i + 8]) for i in range(n - 7)]
    c = Counter(g)
    hit = {j for i, x in enumerate(g) if c[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    if n < 20 or 100 * len(hit) > 30 * n:
        return False
    chars = sum(map(len, w))
    return not (
        len(re.findall(r"[#*$%&|<>]", text)) > 0.5 * n or chars < 2 * n or chars > 20 * n or len(lines) - len(set(lines)) > 0.5 * len(lines) or text.count("|") > 0.2 * n
        or sum(ch.isupper() for ch in text) > 0.5 * chars or len(re.findall("!!", text)) * 2 > 0.5 * n or (sum(x.lower() in STOP_WORDS for x in w) < 0.01 * n and 2 * len(regex.findall(r"\p{Script=Latin}", text)) >= chars) or sum(a == b for a, b in zip(w, w[1:])) > 0.5 * n
    )


def _signed(x):
    return x - 2**64 if x >= 2**63 else x


def _h(*values):
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed)
    return _signed(seed)


def _cut(pattern, text):
    parts = re.split(pattern, text)
    return parts[1:] if len(parts) > 1 and not parts[0] else parts


def lines(text):
    return _cut(ld.LINE_END, text or "")


def _words(line):
    return _cut(ld.WORD_END, line)


def chunk_starts(own):
    """Every place that has the least rolling hash of some window; windows at the end are shorter."""
    h = [_h(x) for x in own]
    roll = [None if i and h[i] == h[i - 1] else (_signed((_h(*h[i : i + 2]) << 31) % 2**64) + i, i) for i in range(len(h) - ld.CHUNK + 1)]
    least = [min((x for x in roll[i : i + ld.WINDOW] if x), default=None) for i in range(len(roll))]
    return sorted({x[1] for x in least if x})


def line_dedup(rows):
    """[(key, text)] -> texts without stretches that stand at an earlier place."""
    docs, places = [], defaultdict(set)
    for n, (k, text) in enumerate(rows):
        own = lines(text)
        starts = chunk_starts(own)
        gap = {s: e - s for s, e in zip(starts, starts[1:])}
        docs.append((own, {s: _h("".join(own[s : s + ld.CHUNK])) for s in starts}, gap, (k is not None, k or 0, _h(text or ""))))
        for s, h in docs[n][1].items():
            places[h].add((*docs[n][3], s, n))
    first = {h: min(p) for h, p in places.items()}
    out = []
    for (own, chunks, gap, doc), (_, text) in zip(docs, rows):
        away = {s: first[h] for s, h in chunks.items() if first[h][:4] != (*doc, s)}
        follows = lambda s, e: s in away and e in away and gap.get(s) == e - s and away[s][:3] == away[e][:3] and away[e][3] - away[s][3] == e - s and docs[away[s][4]][2].get(away[s][3]) == e - s
        before = dict(zip(sorted(chunks)[1:], sorted(chunks)))
        gone, lead, trail = set(), defaultdict(int), defaultdict(int)  # lines, and words next to them
        for s, f in away.items():
            there, o = docs[f[4]][0], f[3]
            if own[s : s + ld.CHUNK] != there[o : o + ld.CHUNK]:
                continue
            a, b, c, d = s, s + ld.CHUNK, o, o + ld.CHUNK
            most = max(d, o + gap[s]) if follows(s, s + gap.get(s, -1)) else min(len(there), d + ld.AROUND)
            while b < len(own) and d < most and own[b] == there[d]:
                b, d = b + 1, d + 1
            if b < len(own) and d < most:
                lead[b] = max(lead[b], _same(_bare(own[b]), _bare(there[d])))
            within = s in before and follows(before[s], s)
            n = max(0, s - before[s] - ld.CHUNK) if within else ld.AROUND
            low, least = max(0, s - n), max(0, o - n)
            while a > low and c > least and own[a - 1] == there[c - 1]:
                a, c = a - 1, c - 1
            if a > low and c > least:
                trail[a - 1] = max(trail[a - 1], _same(_bare(own[a - 1])[::-1], _bare(there[c - 1])[::-1]))
            gone |= set(range(a, b))
        islands = []
        for i in sorted(gone):
            if islands and islands[-1][1] == i:
                islands[-1][1] = i + 1
            else:
                islands.append([i, i + 1])
        islands = [(a, b) for a, b in islands if len(re.findall(WORD, "".join(own[a:b]))) + trail[a - 1] + lead[b] >= ld.LEAST]
        kept, at = "", 0
        for (a, b), head in zip([*islands, (len(own), None)], [0, *[lead[b] for _, b in islands]]):
            said = _words("".join(own[at:a]))
            kept += "".join(said[head : max(head, len(said) - (trail[a - 1] if b else 0))])
            at = b
        out.append(kept if islands else text)
    return out


def _bare(line):
    return [w.lstrip(" \t\n\x0b\x0c\r") for w in _words(line)]


def _same(x, y):
    return next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def components(rows):
    """[(key, text)] -> (key, set size, component) of each row."""
    sets = []
    for _, text in rows:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            o = len(a & sets[j])
            if o and 100 * o >= 75 * (len(a) + len(sets[j]) - o):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return [(d, len(sets[i]), low[root(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


def targets(by_source):
    """Deal by weight, stop at twice the size, deal the excess again until none is above."""
    names = sorted(by_source, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), 1.5 * sum(by_source.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * by_source[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = 2.0 * by_source[s]
            left -= out[s]
        free -= over
    return out


def seats(votes, house):
    """The highest quotients votes / (2 k + 1), one at a time."""
    out = dict.fromkeys(votes, 0)
    for _ in range(house):
        best = min((i for i in votes if votes[i]), key=lambda i: (-votes[i] / (2 * out[i] + 1), i))
        out[best] += 1
    return out


def _seeded(*values):
    text = "|".join(["~" if v is None else str(v) for v in values] + [str(mx.SEED)])
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def source_mix(rows):
    """[(key, source, text)] with distinct keys -> (key, text) of each pass over a document that takes words of it."""
    words = {k: re.findall(rf"{WORD}[\x20\x09-\x0D]*", text) for k, _, text in rows}
    by, text_of = defaultdict(list), {k: text for k, _, text in rows}
    for k, source, _ in rows:
        by[source].append(k)
    size = {s: sum(len(words[k]) for k in ks) for s, ks in by.items()}
    goal = targets(size)
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    dealt = seats({i + 1: goal[s] for i, s in enumerate(names)}, math.floor(sum(goal.values()) / mx.BLOCK + 0.5))
    out = []
    for i, s in enumerate(names):
        n, unit = math.ceil(len(by[s]) / mx.SHARD_DOCS), max(1, min(mx.BLOCK, math.floor(goal[s] / mx.FEW)))
        shards = defaultdict(list)
        for k in by[s]:
            h = _seeded(k, len(words[k]), hashlib.md5(text_of[k].encode()).hexdigest()[:16])
            shards[h % n].append((h, k))
        votes = {j: sum(len(words[k]) for _, k in ks) for j, ks in shards.items()}
        quota = seats(votes, dealt[i + 1] if unit == mx.BLOCK else math.floor(goal[s] / unit + 0.5))
        for j, ks in shards.items():
            v, m = votes[j], math.ceil(votes[j] / unit)
            q, o = min(quota[j], mx.CAP * m), _seeded(i + 1, j)
            stream = [(k, w) for _, k in sorted(ks) for w in words[k]]
            step = mx.STEPS[o % len(mx.STEPS)]
            taken = [defaultdict(list) for _ in range(mx.CAP)]
            for b in range(m):
                times = q // m + ((step * b + o % m) % m < q % m)
                for k, w in stream[b * v // m : (b + 1) * v // m]:
                    for p in range(times):
                        taken[p][k].append(w)
            out += [(k, "".join(ws)) for part in taken for k, ws in part.items()]
    return out
