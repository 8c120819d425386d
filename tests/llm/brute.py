"""Plain versions of what the operators compute, for small inputs."""

import itertools


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def removed_lines(docs, edits=2, least=20):
    """{doc_id: set of line numbers} that an earlier line stands for."""
    lines = sorted((d, k, x) for d, t in docs for k, x in enumerate((t or "").split("\n")) if len(x) >= least)
    first = {}
    for d, k, x in lines:
        first.setdefault(x, (d, k))
    near = {x for x, at in first.items() if any(o < at and abs(len(x) - len(y)) <= edits and edit_distance(x, y) <= edits for y, o in first.items())}
    gone = {}
    for d, k, x in lines:
        if x in near or first[x] != (d, k):
            gone.setdefault(d, set()).add(k)
    return gone


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(docs):
    """{doc_id: smallest linked id} of (doc_id, text)."""
    sets = {d: shingle_set(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        both = len(x & y)
        if both and 100 * both >= 80 * (len(x) + len(y) - both):
            i, j = find(a), find(b)
            root[max(i, j)] = min(i, j)
    return {d: find(d) for d in sets}


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """{source: target}: bounded shares, what is cut off dealt again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, found = share * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not over:
            found |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            found[s] = most * sizes[s]
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return found


def sainte_lague(shares, seats):
    got = [0] * len(shares)
    for _ in range(seats):
        best = max(range(len(shares)), key=lambda i: (shares[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got
