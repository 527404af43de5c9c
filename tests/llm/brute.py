"""Plain Python versions of the operators' contracts, for small inputs.

``docs`` are lists of dicts with doc_id, text, source (and lang).
"""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WS = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


def bpe(docs, tokenizer):
    out = {}
    for d in docs:
        ids = tokenizer.encode(d["text"] or "", add_special_tokens=False).ids
        out[d["doc_id"]] = (len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))
    return out


def line_dedup(docs):
    order = lambda i: (i is None, i or 0)
    holders = defaultdict(set)
    keyed = []
    for d in docs:
        lines = (d["text"] or "").split("\n")
        keys = [x.strip(WS).translate(LOW) for x in lines]
        keyed.append((d["doc_id"], lines, keys))
        for k in keys:
            if len(k) >= 10:
                holders[k].add(d["doc_id"])
    owner = {k: min(v, key=order) for k, v in holders.items() if len(v) >= 2}
    out = []
    for i, lines, keys in keyed:
        kept = [x for x, k in zip(lines, keys) if owner.get(k, i) == i or k not in owner]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def topk(vectors, k=20, divisor=20):
    """vectors: (vec_id, list or None)."""
    import math
    good = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in vectors
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q is None or q % divisor:
            continue
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def substring_dedup(docs, length=400):
    seen = Counter()
    raw = [(d["doc_id"], (d["text"] or "").encode()) for d in docs]
    for _, t in raw:
        for i in range(len(t) - length + 1):
            seen[t[i:i + length]] += 1
    out = []
    for i, t in raw:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for p in range(len(t)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(t), sum(gone), spans, sha(kept)))
    return out


def base_rules(text):
    w = words(text)
    t = text or ""
    lines = [x for x in t.split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i:i + 5])].append(i)
    hit = set()
    for places in at.values():
        if len(places) > 1:
            hit.update(i + k for i in places for k in range(5))
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit),
            len(w) < 10 or 100 * len(hit) > 20 * len(w))


def quality_verdicts(docs, min_docs=20, share=0.1, max_lost=0.8):
    """kept and the remaining text of each document."""
    keyed = []
    for d in docs:
        lines = (d["text"] or "").split("\n")
        keyed.append([(x, x.strip(WS).translate(LOW) if WORD.search(x) else None) for x in lines])
    hosts, holders = defaultdict(set), defaultdict(set)
    for d, lines in zip(docs, keyed):
        whole = frozenset(k for _, k in lines if k is not None)
        hosts[d["source"] or ""].add(whole)
        for k in whole:
            holders[d["source"] or "", k].add(whole)
    out = []
    for d, lines in zip(docs, keyed):
        host = d["source"] or ""
        gone = {k for _, k in lines if k is not None and len(holders[host, k]) > min_docs
                and len(holders[host, k]) > share * len(hosts[host])}
        lost, n = sum(len(words(x)) for x, k in lines if k in gone), len(words(d["text"]))
        out.append((not base_rules(d["text"])[-1] and not lost > max_lost * n,
                    "\n".join(x for x, k in lines if k not in gone) if gone else d["text"]))
    return out


def targets(sizes):
    """sizes by source -> target by source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        rest = total - sum(3 * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {**{s: 3.0 * sizes[s] for s in full}, **share}
        full |= over


def simhash(text):
    w = [x.translate(LOW) for x in words(text)]
    if not w:
        return 0
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(docs):
    order = lambda i: (i is None, i or 0)
    prints = [simhash(d["text"]) for d in docs]
    nodes = sorted(set(prints))
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for d, p in zip(docs, prints):
        r = find(p)
        least[r] = min([d["doc_id"], *([least[r]] if r in least else [])], key=order)
    return [(d["doc_id"], f"{p:016x}", least[find(p)]) for d, p in zip(docs, prints)]


def crc(text):
    return zlib.crc32((text or "").encode())


def smallest_period(w):
    fail, k = [0] * len(w), 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = fail[k - 1]
        k += w[i] == w[k]
        fail[i] = k
    return len(w) - fail[-1] if w else 0


def periodic_runs(w):
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(24, 3 * q) and smallest_period(w[i:i + n]) == q:
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periods(docs):
    out = []
    for d in docs:
        w = words(d["text"])
        h = zlib.crc32(("" if d["doc_id"] is None else str(d["doc_id"])).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = periodic_runs(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        out.append((d["doc_id"], len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                    sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
                    sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def exact_dedup(docs):
    key = lambda i: (i is not None, i or 0)
    texts = [(d["text"] or "").translate(LOW) for d in docs]
    groups = defaultdict(list)
    for d, t in zip(docs, texts):
        groups[t].append(d["doc_id"])
    return [(d["doc_id"], max(groups[t], key=key), len(groups[t]), sha(t)) for d, t in zip(docs, texts)]


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def divergence(docs, min_docs=30, top=50):
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for d in docs:
        lang, source = d["lang"] or "", d["source"] or ""
        terms = TERM.findall((d["text"] or "").translate(LOW))
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    kept = {lang: [t for t, n in c.items() if n >= min_docs] for lang, c in held.items()}

    def shares(lang, c):
        total, v = sum(c[t] for t in kept[lang]), len(kept[lang])
        return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * v) for t in kept[lang]}
    p = {g: shares(g[0], c) for g, c in counts.items()}
    q = {lang: shares(lang, sum((counts[g] for g in counts if g[0] == lang), Counter())) for lang in kept}
    out = []
    for lang, source in counts:
        own = p[lang, source]
        pair = [(-sum(abs(own[t] - p[lang, s][t]) for t in own), s) for x, s in counts if x == lang and s != source]
        term = [(q[lang][t] - own[t], t) for t in own if counts[lang, source][t] and own[t] > q[lang][t]]
        for part, items, most in (("pair", pair, None), ("term", term, top)):
            items.sort(key=lambda x: (x[0], x[1].encode()))
            out += [(lang, source, part, t, -v, i + 1) for i, (v, t) in enumerate(items[:most])]
    return out
