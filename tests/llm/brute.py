"""Plain Python versions of the operators."""
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def near(rows):
    """rows: (doc_id, text) with distinct ids -> {doc_id: (n_shingles, component)}"""
    sets = {}
    for i, text in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    index = {}
    for i in ids:
        hits = {}
        for s in sets[i]:
            for j in index.setdefault(s, []):
                hits[j] = hits.get(j, 0) + 1
            index[s].append(i)
        for j, n in hits.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeats(rows, width=50, words_mode=True):
    """rows: (doc_id, text) -> {doc_id: (n, removed, spans, sha256 of what is kept)}"""
    seqs = {i: (words(t) if words_mode else (t or "").encode()) for i, t in rows}
    first = {}
    for i, s in seqs.items():
        for j in range(len(s) - width + 1):
            k = tuple(s[j:j + width]) if words_mode else s[j:j + width]
            first[k] = min(i, first.get(k, i))
    out = {}
    for i, s in seqs.items():
        gone = [False] * len(s)
        for j in range(len(s) - width + 1):
            k = tuple(s[j:j + width]) if words_mode else s[j:j + width]
            if first[k] < i:
                gone[j:j + width] = [True] * width
        kept = [x for x, g in zip(s, gone) if not g]
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        raw = " ".join(kept).encode() if words_mode else bytes(kept)
        out[i] = (len(s), sum(gone), spans, hashlib.sha256(raw).hexdigest())
    return out


def base_counts(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    seen, where = {}, set()
    for j in range(len(w) - 4):
        seen.setdefault(tuple(w[j:j + 5]), []).append(j)
    for at in seen.values():
        if len(at) > 1:
            where.update(x for j in at for x in range(j, j + 5))
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(where), n < 10 or 100 * len(where) > 20 * n
