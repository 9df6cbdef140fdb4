"""Plain definitions of the operators, and documents with the cases they must survive."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, id long"


def words(n, seed, of=400):
    r = random.Random(seed)
    return [f"w{r.randrange(of)}" for _ in range(n)]


def documents():
    """Copies, near copies, shared passages, repeated words, long, empty and null texts; null and repeated ids."""
    base, passage = words(120, 1), words(70, 2)
    near = base[:60] + ["changed"] + base[61:]
    texts = {
        1: " ".join(base), 2: "  ".join(base), 3: " ".join(near), 4: " ".join(near[:-1]),
        5: " ".join(words(90, 3) + passage + words(40, 4)), 6: " ".join(words(30, 5) + passage + words(80, 6)),
        7: "Was. " * 300, 8: "", 9: None, 10: " \t\n ", 11: "one two three", 12: "ONE two three", 13: "é" * 900, 14: "é" * 900,
        15: " ".join(words(6000, 7, 10**6)), 16: " ".join(words(100, 8) + words(30, 9) + words(100, 8)), 17: "x" * 5000, 18: "a\x00b </s> \\e [INST]",
        19: " ".join(words(55, 2)[5:]), 20: "123 456 !!",
    }
    rows = [(i, t, ["en", "de", None][i % 3], [None, "s1", "s2", "s3"][i % 4]) for i, t in texts.items()]
    rows += [rows[0], (None, texts[5], None, None), (None, "only here " * 60, "en", "s1"), (3, "another text under a used id " * 20, "en", "s9")]
    return [(i, t, lang, source, len(t or ""), "k", 0, 1) for i, t, lang, source in rows]


def split(text):
    return (text or "").encode().split()


def passages(rows, width=50):
    least, out = {}, []
    number = lambda i: (1 << 63) if i is None else i
    for i, t in rows:
        w = split(t)
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            least[k] = min(least.get(k, 1 << 64), number(i))
    for i, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if least[tuple(w[s : s + width])] < number(i):
                gone[s : s + width] = [True] * width
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def strings(rows, width=400):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[s : s + width] for t in texts for s in range(len(t) - width + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for s in range(len(t) - width + 1):
            if count[t[s : s + width]] > 1:
                gone[s : s + width] = b"\1" * width
        runs = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest()))
    return out


def near(rows, length=4):
    """component by id; rows that share an id are one node, null ids follow an equal set."""
    sets, by_id = [], defaultdict(list)
    for i, t in rows:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        s = frozenset(tuple(w[k : k + length]) for k in range(len(w) - length + 1)) if len(w) >= length else frozenset([tuple(w)] if w else [])
        sets.append(s)
        by_id[i].append(s)
    parent = {i: i for i in by_id if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(parent)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in by_id[a] for y in by_id[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    out = []
    for (i, _), s in zip(rows, sets):
        same = [j for j in ids if s in by_id[j]]
        c = i if not s else find(i) if i is not None else (find(min(same)) if same else None)
        out.append((i, len(s), c, i == c))
    return out


def crc(text):
    return zlib.crc32(text.encode())


def trie(rows):
    """Nodes of the prefix trie of rebuilt conversations; rows are (conv_id, turn, role, text)."""
    number = lambda c: (1 << 63) - 1 if c is None else c
    shown = lambda c: None if c == (1 << 63) - 1 else c
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[number(c)].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = crc("" if shown(c) is None else str(c)) % 6
        base = None if shown(c) is None else c - int(math.fmod(c, 100))
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, v in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(v) - 1) * len(k[-1][1]) if k else 0
    out = []
    for k, v in members.items():
        ends = ",".join("" if shown(c) is None else str(c) for c in sorted(v) if len(built[c]) == len(k))
        out.append((shown(min(v)), len(k), shown(min(members[k[:-1]])) if k else None, len(v), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def variants(rows, min_count=5):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc(f"{'' if i is None else i}:{run}")
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= min_count}
    holes = defaultdict(set)
    for w in n:
        holes[w].add(w)
        for k in range(len(w)):
            holes[w[:k] + w[k + 1 :]].add(w)
            holes[k, w[:k] + w[k + 1 :]].add(w)
    near = defaultdict(set)
    for key, group in holes.items():
        for a in group:
            near[a].update(b for b in group if a != b and (isinstance(key, tuple) or key in (a, b)))
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= 5 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3), passes: int = 3) -> dict[str | None, Fraction]:
    """Share of the total size per source.

    Sources in code-point order, null last, take the weights in turn; a share stops at ``passes``
    times the source's size and the excess goes to the others by weight until none is above.
    """
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = Fraction(sum(sizes.values())), {}, set(names)
    while open_:
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / whole > passes * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / whole for s in open_}
        out |= {s: Fraction(passes * sizes[s]) for s in over}
        left -= sum(passes * sizes[s] for s in over)
        open_ -= over
    return out
