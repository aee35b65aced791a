"""Trees and the gap statistic on small figures."""

import re

import numpy as np

from panweave.functions import models


def paths(newick):
    """Distances between the leaves of a Newick text."""
    parent, length, leaf, stack, last = {}, {}, {}, [], None
    for token in re.findall(r"[(),;]|[^(),;]+", newick):
        if token == "(":
            node = len(parent)
            parent[node] = stack[-1] if stack else None
            length[node] = 0.0
            stack.append(node)
        elif token == ")":
            last = stack.pop()
        elif token not in ",;":
            name, _, size = token.partition(":")
            if name:
                last = len(parent)
                parent[last] = stack[-1]
                leaf[name] = last
            length[last] = float(size or 0)

    def up(x):
        out, at = {}, 0.0
        while x is not None:
            out[x] = at
            at += length[x]
            x = parent[x]
        return out

    return {(a, b): min(up(x)[k] + up(y)[k] for k in up(x).keys() & up(y).keys()) for a, x in leaf.items() for b, y in leaf.items()}


def test_neighbour_joining_finds_an_additive_tree():
    tree = "(((a:1,b:2.5):0.7,(c:3,d:0.4):1.1):0.9,e:2,(f:0.3,g:1.9):2.2);"
    want = paths(tree)
    names = list("gbecafd")
    distance = np.array([[want[x, y] for y in names] for x in names])
    got = paths(models.bionj(names, distance))
    assert all(abs(got[k] - want[k]) < 1e-4 for k in want)
    assert models.bionj(["x", "y"], np.array([[0, 3.0], [3.0, 0]])) == "(x:1.5,y:1.5);"


def test_cut_and_gap_find_three_clouds():
    rng = np.random.default_rng(1)
    points = np.concatenate([c + 0.1 * rng.standard_normal((8, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    distance = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    for method in ("average", "complete", "single"):
        label = models.cut_tree(distance, 3, method)
        assert [len(set(label[i : i + 8])) for i in (0, 8, 16)] == [1, 1, 1] and len(set(label)) == 3
    gaps = models.gap_statistic(points, 5, 20)
    first = next(k for k, g, _ in gaps if k == 5 or g >= gaps[k][1] - gaps[k][2])
    assert first == 3 and max(gaps, key=lambda x: x[1])[0] >= 3
