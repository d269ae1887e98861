"""Plain versions of the operators, for small inputs."""

import re
from collections import Counter, defaultdict

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Union:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def shingle_set(text, width=3):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def linked(a, b, num, den):
    both = len(a & b)
    return both > 0 and den * both >= num * (len(a) + len(b) - both)


def jaccard(rows, num=90, den=100, width=3):
    """(doc_id, n_shingles, component_id) of every row."""
    sets = [shingle_set(t, width) for _, t in rows]
    union = Union()
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and linked(sets[a], sets[b], num, den):
                union.join(a, b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[union.find(k)].append(i)
    return Counter((i, len(s), min(least[union.find(k)], default=None)) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def line_keeping(rows, num=80, den=100):
    """n_lines and the dropped lines of every distinct (doc_id, text), rows in order."""
    lines = []
    for d, (_, text) in enumerate(rows):
        for k, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\n\x0b\x0c\r"):
                lines.append((d, k, line.translate(FOLD)))
    distinct = {line: n for n, line in enumerate(dict.fromkeys(line for *_, line in lines))}
    sets = [frozenset(x[i : i + 5] for i in range(max(1, len(x) - 4))) for x in distinct]
    union = Union()
    for a in range(len(sets)):
        for b in range(a):
            if min(len(sets[a]), len(sets[b])) * den >= num * max(len(sets[a]), len(sets[b])) and linked(sets[a], sets[b], num, den):
                union.join(a, b)
    first, count, dropped = {}, Counter(), defaultdict(list)
    for d, k, line in lines:
        count[d] += 1
        root = union.find(distinct[line])
        if root in first:
            dropped[d].append((k, *first[root]))
        else:
            first[root] = (d, k)
    return count, dropped


def hit_words(text, items, width=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))

    w, hit, named = words(text), set(), set()
    for item, t in items:
        v = words(t)
        for s in range(max(1, len(v) - width + 1)) if v else ():
            window = v[s : s + width]
            for p in range(len(w) - len(window) + 1):
                if w[p : p + len(window)] == window:
                    hit.update(range(p, p + len(window)))
                    named.add(item)
    return len(w), len(hit), named - {None}
