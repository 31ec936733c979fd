"""What the operators should give, by plain loops."""

import hashlib
import re
from collections import Counter, defaultdict


def links(rows):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append(frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(rows[a][0]), find(rows[b][0])
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for (i, _), s in zip(rows, sets))


def removed(rows, length):
    seen = Counter(r[k : k + length] for r in ((t or "").encode() for _, t in rows) for k in range(len(r) - length + 1))
    out = []
    for i, t in rows:
        r, spans = (t or "").encode(), []
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + length
                else:
                    spans.append([k, k + length])
        kept, at = b"", 0
        for s, e in spans:
            kept, at = kept + r[at:s], e
        kept += r[at:]
        out.append((i, len(r), len(r) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def personal(text):
    def luhn(d):
        s = 0
        for k, c in enumerate(reversed(d)):
            v = int(c) * (1 + k % 2)
            s += v - 9 * (v > 9)
        return s % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    found = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if ok(m[0])] for k, (p, ok) in kinds.items()}
    joined = ",".join(s for k in kinds for s in found[k])
    return [len(found[k]) for k in kinds], hashlib.sha256(joined.encode()).hexdigest(), joined


def keepers(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    return sorted((i, max(by[t or ""]), len(by[t or ""]), i == max(by[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
