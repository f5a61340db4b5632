"""Plain Python versions of the fuzzy measures, for comparison on small inputs."""


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def dice(a, b):
    if a == b:
        return 1.0 if a else 0.0
    if min(len(a), len(b)) < 2:
        return 0.0
    left = [a[i : i + 2] for i in range(len(a) - 1)]
    right = [b[i : i + 2] for i in range(len(b) - 1)]
    shared = sum(min(left.count(g), right.count(g)) for g in set(left))
    return 2 * shared / (len(left) + len(right))


def ratio(a, b):
    return min(len(a), len(b)) / max(len(a), len(b))


def stands(t):
    return len(t) >= 3 or (len(t) == 2 and any(c.isdigit() for c in t))


def band(d):
    return 0.58 + (d - 0.72) * 0.9 if d >= 0.72 else 0.0


def token(q, t):
    if not q or not t:
        return 0.0
    if q == t:
        return 1.0
    if t.startswith(q) or (stands(t) and q.startswith(t)):
        return 0.82 + 0.12 * ratio(q, t)
    if min(len(q), len(t)) < 3:
        return 0.0
    if q in t or t in q:
        return 0.68 + 0.18 * ratio(q, t)
    if q[0] == t[0] and edit(q, t) <= 2:
        return 0.72 + (2 - edit(q, t)) / 2 * 0.16
    return band(dice(q, t))


def packed(q, t):
    if not q or not t:
        return 0.0
    if q == t:
        return 1.0
    if len(q) < 3 and not any(c.isdigit() for c in q):
        return 0.0
    if t.startswith(q) or (stands(t) and q.startswith(t)):
        return 0.84 + 0.12 * ratio(q, t)
    if q in t or (stands(t) and t in q):
        return 0.76 + 0.16 * ratio(q, t)
    k = min(3, max(2, max(len(q), len(t)) // 4))
    if edit(q, t) <= k:
        return 0.62 + (k - edit(q, t)) / k * 0.18
    return band(dice(q, t))


def part(q, t):
    if q == t:
        return 1.0
    r, big = ratio(q, t), len(t) >= 5
    if t.startswith(q):
        return 0.92 + r * 0.06
    if big and q.startswith(t):
        return 0.82 + r * 0.08
    if q in t:
        return 0.86 + r * 0.06
    if big and t in q:
        return 0.76 + r * 0.08
    lead = next((i for i, (x, y) in enumerate(zip(q, t)) if x != y), min(len(q), len(t)))
    share, longer = lead / min(len(q), len(t)), max(len(q), len(t))
    k = min(4, max(2, longer // 4))
    e = 1 - edit(q, t) / longer if edit(q, t) <= k else 0.0
    d = dice(q, t)
    if lead >= 5:
        if e >= 0.72:
            return max(0.68, min(0.91, e * 0.68 + share * 0.23 + d * 0.09))
        if d >= 0.72:
            return max(0.62, min(0.84, share * 0.48 + d * 0.34))
        return max(0.54, min(0.82, share * 0.62 + r * 0.12 + d * 0.08))
    if lead >= 4 and min(len(q), len(t)) <= 6:
        return max(0.6, min(0.82, share * 0.7 + r * 0.1))
    return min(0.78, d * 0.72 + share * 0.08) if d >= 0.82 and lead >= 3 else 0.0
