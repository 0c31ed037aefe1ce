"""Plain versions of the operators, straight from their contracts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_duplicates(docs):
    """doc_id -> (n_shingles, component)"""
    sets = {i: shingles(t) for i, t in docs if i is not None}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    pairs = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def without_repeats(docs, length=200):
    """A list of (doc_id, n_bytes, n_removed, n_spans, sha256)"""
    texts = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


KINDS = {
    "assign": re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def secrets(text):
    """(counts, base line)"""
    spans, counts = [], []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        own = [m for m in pattern.finditer(text or "") if len(m.group(2) if kind == "assign" else m.group()) >= {"assign": 12, "access": 18, "hex": 16}[kind]]
        counts.append(len(own))
        spans += [(m.start(), k, m.end(), kind) for m in own]
    line = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans))
    return counts, line


def token_rows(docs, path, end=1):
    """A list of (doc_id, start, n_tokens, crc32) for documents in their written order."""
    import numpy as np
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    out, start = [], 0
    for i, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def leaks(docs, items, threshold=0.75):
    """(doc_id, item_id) of all windows as long as the item, by weighted shingle similarity."""
    def listed(text):
        w = WORD.findall((text or "").translate(LOW))
        return [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [("whole", *w)] if w else []

    found = set()
    for item_id, text in items:
        s = listed(text)
        own = Counter(s)
        for doc_id, t in docs:
            d = listed(t)
            if not s or not set(d) & set(s):
                continue
            for k in range(1 - len(s), len(d)):
                w = Counter(d[max(0, k) : max(0, k + len(s))])
                low = sum((w & own).values())
                if low and low / (sum(w.values()) + len(s) - low) >= threshold:
                    found.add((doc_id, item_id))
                    break
    return found


def entropy_spans(text, allow, thresholds, width=20):
    """Spans of windows over their class's threshold, each window counted anew."""
    import math

    out = []
    for run in re.finditer(r"[A-Za-z0-9+/_=-]{%d,}" % width, text or ""):
        r = run.group()
        covered = [m.span() for p in allow for m in re.finditer(p, r)]
        hits = []
        for k in range(len(r) - width + 1):
            w = r[k : k + width]
            digit, lower, upper = (any(f(c) for c in w if c.isascii()) for f in (str.isdigit, str.islower, str.isupper))
            if digit and (lower or upper):
                kind = "hex" if all(c in "0123456789abcdefABCDEF" for c in w) else "base64" if lower and upper else "one_case"
            elif lower or upper:
                kind = "letters" if lower and upper else "one_case_letters"
            else:
                continue
            h = -sum(n / width * math.log2(n / width) for n in Counter(w).values())
            if h > thresholds[kind] and not any(a < k + width and b > k for a, b in covered):
                hits.append(k)
        merged = []
        for k in hits:
            if merged and k < merged[-1][1]:
                merged[-1][1] = k + width
            else:
                merged.append([k, k + width])
        out += [(run.start() + a, run.start() + b) for a, b in merged]
    return out


def factorisation_machine(rows, y, dims, rank, v0, epochs, batch, rate, decay, orders):
    """Weights (bias, w, v) after Adagrad over rows of (feature, value), written out term by term."""
    import math

    n = len(y)
    weight = [n / 2 / max(1, sum(b == a for b in y)) for a in y]
    w, v, bias = [0.0] * dims, [list(x) for x in v0], 0.0
    gw, gv, gb = [1e-8] * dims, [[1e-8] * rank for _ in range(dims)], 1e-8
    for epoch in range(epochs):
        order = orders(n, epoch)
        for k in range(0, n, batch):
            own = order[k : k + batch]
            dw, dv, db = defaultdict(float), defaultdict(lambda: [0.0] * rank), 0.0
            for i in own:
                margin = bias + sum(w[f] * x for f, x in rows[i])
                margin += sum(sum(a * b for a, b in zip(v[f], v[g])) * x * z for p, (f, x) in enumerate(rows[i]) for g, z in rows[i][:p])
                g = (1 / (1 + math.exp(-margin)) - y[i]) * weight[i] / len(own)
                db += g
                sums = [sum(v[f][r] * x for f, x in rows[i]) for r in range(rank)]
                for f, x in rows[i]:
                    dw[f] += g * x
                    for r in range(rank):
                        dv[f][r] += g * x * (sums[r] - v[f][r] * x)
            for f in dw:
                d = dw[f] + decay * w[f]
                gw[f] += d * d
                w[f] -= rate * d / math.sqrt(gw[f])
                for r in range(rank):
                    d = dv[f][r] + decay * v[f][r]
                    gv[f][r] += d * d
                    v[f][r] -= rate * d / math.sqrt(gv[f][r])
            gb += db * db
            bias -= rate * db / math.sqrt(gb)
    return bias, w, v


def boosted_trees(rows, names, trees, rate, penalty):
    """Margins of trees of depth 2 for rows of (bins by name, y, weight), every split tried on every row."""
    import math

    margin = [0.0] * len(rows)

    def best(own):
        found = None
        for name in names:
            for edge in sorted({rows[i][0][name] for i in own}):
                left, right = [i for i in own if rows[i][0][name] <= edge], [i for i in own if rows[i][0][name] > edge]
                part = lambda ids: (sum(g[i] for i in ids), sum(h[i] for i in ids))
                (a, b), (c, d) = part(left), part(right)
                gain = a * a / (b + penalty) + c * c / (d + penalty) - (a + c) ** 2 / (b + d + penalty)
                split = round(gain, 9), name, edge, -rate * a / (b + penalty), -rate * c / (d + penalty), left, right
                found = max(found or split, split, key=lambda s: s[:5])
        return found

    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g = [w * (q - y) for (_, y, w), q in zip(rows, p)]
        h = [w * q * (1 - q) for (_, y, w), q in zip(rows, p)]
        top = best(range(len(rows)))
        if top[0] <= 0:
            continue
        for value, ids in ((top[3], top[5]), (top[4], top[6])):
            deeper = best(ids) if ids else None
            if deeper and deeper[0] > 0:
                for v, own in ((deeper[3], deeper[5]), (deeper[4], deeper[6])):
                    for i in own:
                        margin[i] += v
            else:
                for i in ids:
                    margin[i] += value
    return margin
