"""Rooted trees as tables of nodes.

A tree is the small side of every job (a row for each node), so it is held on the driver, edited there, and turned into
a DataFrame for joins. What grows with the data - sites, queries, likelihood vectors - never comes here.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

TOKEN = re.compile(r"\s*(?:\[[^\]]*\]\s*)*('(?:[^']|'')*'|[(),:;]|[^\s(),:;'\[]+)")
QUOTED = re.compile(r"[()\[\]:;,'\s]")
LEAST_LENGTH, MOST_LENGTH, PENDANT = 1e-4, 100.0, 0.10536051565782628
NODES = "node_id int, parent_id int, left_id int, right_id int, is_tip boolean, name string, blen double, post_ix int, pre_ix int, height int, depth int"

STATE = "node int, parent int, place int, name string, blen double, is_root boolean"


class Tree:
    """Parallel lists by node id. Removed nodes have no parent and aren't reached from the root."""

    def __init__(self) -> None:
        self.parent: list[int | None] = []
        self.children: list[list[int]] = []
        self.name: list[str | None] = []
        self.blen: list[float] = []
        self.root = 0

    def add(self, name: str | None = None, blen: float = 0.0) -> int:
        self.parent.append(None)
        self.children.append([])
        self.name.append(name)
        self.blen.append(blen)
        return len(self.parent) - 1

    def hang(self, child: int, parent: int, at: int | None = None) -> None:
        self.parent[child] = parent
        self.children[parent].insert(len(self.children[parent]) if at is None else at, child)

    def copy(self) -> Tree:
        new = Tree()
        new.parent, new.name, new.blen, new.root = list(self.parent), list(self.name), list(self.blen), self.root
        new.children = [list(x) for x in self.children]
        return new

    # Orders and relations

    def preorder(self, top: int | None = None) -> Iterator[int]:
        stack = [self.root if top is None else top]
        while stack:
            node = stack.pop()
            yield node
            stack += reversed(self.children[node])

    def postorder(self, top: int | None = None) -> list[int]:
        out, stack = [], [self.root if top is None else top]
        while stack:
            node = stack.pop()
            out.append(node)
            stack += self.children[node]
        return out[::-1]

    def tips(self) -> list[int]:
        return [n for n in self.preorder() if not self.children[n]]

    def edges(self) -> list[int]:
        """An edge is named by the node below it."""
        return [n for n in self.preorder() if self.parent[n] is not None]

    def sibling(self, node: int) -> int:
        a, b = self.children[self.parent[node]]
        return b if a == node else a

    def neighbours(self, node: int) -> list[int]:
        return self.children[node] + ([] if self.parent[node] is None else [self.parent[node]])

    def hops(self, sources: list[int]) -> dict[int, int]:
        """Numbers of edges to the nearest source."""
        found, queue = dict.fromkeys(sources, 0), deque(sources)
        while queue:
            node = queue.popleft()
            for other in self.neighbours(node):
                if other not in found:
                    found[other] = found[node] + 1
                    queue.append(other)
        return found

    def path(self, a: int, b: int) -> list[int]:
        """The nodes from a to b, through their lowest common ancestor."""
        up, at = [a], a
        while self.parent[at] is not None:
            at = self.parent[at]
            up.append(at)
        place, down, at = {n: k for k, n in enumerate(up)}, [], b
        while at not in place:
            down.append(at)
            at = self.parent[at]
        return up[: place[at] + 1] + down[::-1]

    def lowest(self, nodes: set[int]) -> list[int]:
        """Those of some nodes that have none of them below."""
        above = set()
        for node in nodes:
            while (node := self.parent[node]) is not None and node not in above:
                above.add(node)
        return sorted(nodes - above)

    # Text

    @classmethod
    def parse(cls, text: str, binary: bool = True) -> Tree:
        """Newick with quotes and comments; inner nodes of more than two children become left-deep pairs."""
        tree, tokens = cls(), TOKEN.findall(text)
        if "".join(tokens[-1:]) != ";" or "".join(tokens) != re.sub(r"\[[^\]]*\]", "", re.sub(r"('(?:[^']|'')*')|\s", lambda m: m[1] or "", text)):
            raise ValueError("not a Newick tree that ends in ';'")
        at = tree.add()
        tree.root, waits = at, False
        for token in tokens[:-1]:
            if token == "(":
                child = tree.add()
                tree.hang(child, at)
                at = child
            elif token == ",":
                if tree.parent[at] is None:
                    raise ValueError("a comma outside of parentheses")
                child = tree.add()
                tree.hang(child, tree.parent[at])
                at = child
            elif token == ")":
                at = tree.parent[at]
                if at is None:
                    raise ValueError("a closing parenthesis too many")
            elif token == ":":
                waits = True
            elif waits:
                tree.blen[at], waits = float(token), False
            else:
                tree.name[at] = token[1:-1].replace("''", "'") if token[0] == "'" else token
        if at != tree.root:
            raise ValueError("a closing parenthesis is missing")
        if any(tree.children[n] == [] and not tree.name[n] for n in tree.preorder()):
            raise ValueError("a tip has no name")
        return tree.resolved() if binary else tree

    def resolved(self) -> Tree:
        """Two children everywhere: extra ones are paired from the left with branches of length 0; single ones merge."""
        for node in self.postorder():
            while len(self.children[node]) > 2:
                a, b = self.children[node][:2]
                pair = self.add()
                del self.children[node][:2]
                for child in (a, b):
                    self.hang(child, pair)
                self.hang(pair, node, 0)
            if len(self.children[node]) == 1:
                (only,) = self.children[node]
                self.blen[node] += self.blen[only]
                self.name[node], self.children[node] = self.name[only] or self.name[node], self.children[only]
                for child in self.children[node]:
                    self.parent[child] = node
                self.parent[only], self.children[only] = None, []
        return self.renumbered()

    def renumbered(self) -> Tree:
        """Ids in pre-order, without gaps."""
        new, ids = Tree(), {}
        for node in self.preorder():
            ids[node] = new.add(self.name[node], self.blen[node])
            if node != self.root:
                new.hang(ids[node], ids[self.parent[node]])
        return new

    def newick(self, edge_numbers: dict[int, int] | None = None, collapse: float | None = None) -> str:
        """17 digits a length; inner branches up to ``collapse`` are left out, their lengths go to the nodes below."""
        texts: dict[int, list[str]] = {}
        extra = {self.root: 0.0}
        shut: set[int] = set()
        for node in self.preorder():
            for child in self.children[node]:
                length = self.blen[child] + (extra[node] if node in shut else 0.0)
                extra[child] = length
                if collapse is not None and self.children[child] and length <= collapse:
                    shut.add(child)
        for node in self.postorder():
            below = [t for child in self.children[node] for t in texts.pop(child)]
            if node in shut:
                texts[node] = below
                continue
            label = f"({','.join(below)})" if below else ""
            if not self.children[node] and self.name[node] is not None:
                label += quoted(self.name[node])
            if node != self.root:
                label += f":{extra[node]:.17g}"
                if edge_numbers is not None and node in edge_numbers:
                    label += f"{{{edge_numbers[node]}}}"
            texts[node] = [label]
        return texts[self.root][0] + ";"

    # Edits

    def split(self, edge: int, distal: float) -> int:
        """A new node on an edge, ``distal`` above its lower end."""
        distal = min(max(distal, 0.0), self.blen[edge])
        up = self.parent[edge]
        at = self.children[up].index(edge)
        new = self.add(None, self.blen[edge] - distal)
        self.children[up][at], self.parent[new] = new, up
        self.hang(edge, new)
        self.blen[edge] = distal
        return new

    def insert(self, name: str, edge: int, distal: float, pendant: float) -> int:
        """A new tip on an edge; a name that is taken gets its id as a suffix."""
        new = self.split(edge, distal)
        tip = self.add(name, min(max(pendant, LEAST_LENGTH), MOST_LENGTH))
        if name in {self.name[n] for n in self.tips()}:
            self.name[tip] = f"{name}_{tip}"
        self.hang(tip, new)
        return tip

    def prune(self, node: int) -> tuple[int, float, float]:
        """Take a subtree off; its parent goes, and the sibling keeps both lengths. Returns what ``graft`` needs to undo it."""
        up, other = self.parent[node], self.sibling(node)
        below, above = self.blen[other], self.blen[up]
        top = self.parent[up]
        if top is None:
            self.root, self.parent[other] = other, None
        else:
            self.children[top][self.children[top].index(up)] = other
            self.parent[other] = top
            self.blen[other] = below + above
        self.parent[node], self.parent[up], self.children[up] = None, None, []
        return other, below, self.blen[node]

    def graft(self, node: int, edge: int, distal: float, pendant: float) -> None:
        """Hang a pruned subtree on an edge; its length is held to the bounds of an inserted tip's, but 0 stays 0."""
        new = self.split(edge, distal)
        self.blen[node] = min(max(pendant, LEAST_LENGTH), MOST_LENGTH) if pendant else 0.0
        self.hang(node, new)

    def without(self, names: set[str]) -> Tree:
        """The tree without these tips."""
        new = self.copy()
        for node in new.postorder():
            if node != new.root and not new.children[node] and (new.name[node] in names or self.children[node]):
                new.children[new.parent[node]].remove(node)
                new.parent[node] = None
        return new.resolved()

    # Tables

    def rows(self) -> list[tuple]:
        post = {n: k for k, n in enumerate(self.postorder())}
        height: dict[int, int] = {}
        for node in post:
            height[node] = 1 + max((height[c] for c in self.children[node]), default=-1)
        depth, out = {}, []
        for k, node in enumerate(self.preorder()):
            up = self.parent[node]
            depth[node] = 0 if up is None else depth[up] + 1
            left, right = self.children[node] or (None, None)
            out.append((node, up, left, right, not self.children[node], self.name[node], self.blen[node], post[node], k, height[node], depth[node]))
        return out

    def nodes(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), NODES)

    def state(self, spark: SparkSession) -> DataFrame:
        """All that ``restored`` needs for the same tree with the same ids, removed nodes too: a row for each node."""
        place = {c: k for own in self.children for k, c in enumerate(own)}
        rows = [(n, self.parent[n], place.get(n, 0), self.name[n], self.blen[n], n == self.root) for n in range(len(self.parent))]
        return spark.createDataFrame(rows, STATE)

    @classmethod
    def restored(cls, state: DataFrame) -> Tree:
        tree = cls()
        rows = sorted(state.collect(), key=lambda r: r["node"])
        for r in rows:
            tree.add(r["name"], r["blen"])
            if r["is_root"]:
                tree.root = r["node"]
        for r in sorted(rows, key=lambda r: r["place"]):
            if r["parent"] is not None:
                tree.hang(r["node"], r["parent"])
        return tree


def quoted(name: str) -> str:
    return "'" + name.replace("'", "''") + "'" if not name or QUOTED.search(name) else name
