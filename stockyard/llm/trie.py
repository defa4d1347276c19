"""A compressed radix trie over byte strings whose terminal nodes keep an owner and a count."""

from __future__ import annotations

from collections.abc import Iterator

from stockyard.shipping import ship_by_value

ship_by_value(__name__)


def common_prefix(a: bytes, b: bytes, start: int, limit: int) -> int:
    """How far `a[start:]` and `b[start:]` agree, at most `limit`; compares slices by halves."""
    if a[start : start + limit] == b[start : start + limit]:
        return limit
    lo, hi = 0, limit
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[start + lo : start + mid] == b[start + lo : start + mid]:
            lo = mid
        else:
            hi = mid
    return lo


class Node:
    """Holds the end of its edge's label; the label is `text[parent.end:end]` of any key below."""

    __slots__ = ("children", "end", "owner", "owner_copies", "size", "text")

    def __init__(self, text: bytes, end: int):
        self.text, self.end = text, end
        self.children: dict[int, Node] | None = None
        self.size = 0  # rows that end here; 0 for a node that only branches
        self.owner: int | None = None
        self.owner_copies = 0

    def claim(self, owner: int | None, copies: int, size: int, largest: bool) -> None:
        """Take in rows of this text; a null identifier never beats another."""
        self.size += size
        if owner == self.owner:
            self.owner_copies += copies
        elif self.owner is None or (owner is not None and (owner > self.owner) == largest):
            self.owner, self.owner_copies = owner, copies


class PatriciaTrie:
    """Exact owners of byte strings.

    Every string is compared byte by byte along its path, so two texts share a
    terminal only if they are identical. `held` is the number of bytes of the
    strings that the trie keeps alive.
    """

    def __init__(self, largest: bool = False):
        self.root = Node(b"", 0)
        self.largest = largest
        self.held = 0

    def insert(self, text: bytes, owner: int | None, copies: int = 1, size: int = 1) -> None:
        node, n = self.root, len(text)
        while node.end < n:
            at = node.end
            if node.children is None:
                node.children = {}
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text, n)
                self.held += n
                child.claim(owner, copies, size, self.largest)
                return
            span = min(child.end, n) - at
            same = common_prefix(child.text, text, at, span)
            if at + same < child.end:  # the edge is split where the texts part
                split = Node(child.text, at + same)
                split.children = {child.text[at + same]: child}
                node.children[text[at]] = child = split
            node = child
        if not node.size:
            self.held += n
        node.text = text  # frees a longer string that this prefix was borrowed from
        node.claim(owner, copies, size, self.largest)

    @staticmethod
    def terminals(top: Node) -> Iterator[Node]:
        """Nodes at which texts end, in byte order."""
        stack = [top]
        while stack:
            node = stack.pop()
            if node.size:
                yield node
            if node.children:
                stack.extend(node.children[k] for k in sorted(node.children, reverse=True))

    def spill_largest(self) -> Iterator[Node]:
        """Cut the root's largest subtree off and give its terminals; all of the trie if it is one."""
        if self.root.size or not self.root.children:
            yield from self.spill_all()
            return
        weights = {k: sum(len(t.text) for t in self.terminals(c)) for k, c in self.root.children.items()}
        cut = max(weights, key=weights.get)
        top = self.root.children.pop(cut)
        self.held -= weights[cut]
        yield from self.terminals(top)

    def spill_before(self, text: bytes) -> Iterator[Node]:
        """With keys that come in byte order: cut off all subtrees that lie wholly before `text`."""
        node, parents = self.root, []
        while node.children:
            for k in sorted(node.children):
                child = node.children[k]
                ahead = text[node.end : node.end + 1] == bytes([k]) and text[: child.end] == child.text[: child.end]
                if not ahead and child.text[: child.end] < text[: child.end]:
                    del node.children[k]
                    for t in self.terminals(child):
                        self.held -= len(t.text)
                        yield t
            step = node.children.get(text[node.end]) if node.end < len(text) else None
            if step is None or text[: step.end] != step.text[: step.end]:
                return
            parents.append(node)
            node = step

    def spill_all(self) -> Iterator[Node]:
        top, self.root, self.held = self.root, Node(b"", 0), 0
        yield from self.terminals(top)
