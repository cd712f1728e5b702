"""Brute-force helpers that several tests share."""


def classes_of(n, linked):
    """Class (smallest number) of 0..n-1 under chains of ``linked`` pairs."""
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        p, q = top(a), top(b)
        up[max(p, q)] = min(p, q)
    return [top(x) for x in range(n)]
