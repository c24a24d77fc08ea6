"""Plain helpers shared by tests."""


def labels_of(n, edges):
    """Least vertex of each component, by union-find."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return [find(i) for i in range(n)]
