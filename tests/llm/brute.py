"""Plain versions of the operators for small inputs."""

import re


def kept_words(rows, window=13):
    """(doc_id, words, removed, kept) of each row; rows without id come last and take nothing from each other."""
    first, words = {}, [(r[0], (r[1] or "").encode().split()) for r in rows]
    order = lambda i: (i is None, i or 0)
    for i, w in words:
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            first[k] = min(first.get(k, order(i)), order(i))
    for i, w in words:
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < order(i):
                gone.update(range(j, j + window))
        yield i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone)


def likeness_rows(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def components(rows, share=85):
    """{doc_id: (set size, component)} over all pairs."""
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets[r[0]] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= share * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in sets}
