"""A small HTML tree for block-level nodes, read with one regular expression in time linear in the page, however deep it is."""

from __future__ import annotations

import html
import re

# Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template noscript".split())
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption script style textarea title select option button template noscript iframe "
    "svg math object video audio canvas".split()
)
CLOSES_P = BLOCK - frozenset("html head body option button select textarea script style title template noscript iframe svg math object video audio canvas td th tr tbody thead tfoot caption".split())
ENDS_BEFORE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements above which an open paragraph is not looked for.
P_SCOPES = ("button", "td", "th", "table", "caption", "object", "template")
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}

_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|aria-label|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_TOKENS = re.compile(r"[a-z]+")


class Node:
    """A block-level element: its place in the tree and the runs of text directly in it."""

    __slots__ = ("tag", "tokens", "parent", "depth", "n_children", "runs", "links", "link_chars", "inline", "order", "end")

    def __init__(self, tag: str, tokens: tuple, parent: "Node | None", order: int):
        self.tag, self.tokens, self.parent, self.order = tag, tokens, parent, order
        self.depth = parent.depth + 1 if parent else 0
        self.n_children = 0
        self.runs: list[tuple[int, str]] | tuple = ()  # (place in the page, text)
        self.links = self.link_chars = self.inline = 0
        self.end = order


def attribute_tokens(attributes: str) -> tuple:
    """Lower-case words of class, id, role and label; a mark for hidden elements."""
    out: list[str] = []
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        if name.lower() == "style":
            if "display:none" in value.replace(" ", ""):
                out.append("hidden")
        elif name.lower() == "hidden":
            out.append("hidden")
        else:
            out += _TOKENS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower())
    return tuple(out)


def parse(page: str) -> list[Node]:
    """Block-level nodes in page order; the first is a root above all."""
    nodes = [Node("#root", (), None, 0)]
    block, stack, place = nodes[0], [], 0  # stack: inline elements and blocks, innermost last: (tag, node or None)
    open_: dict[str, list[int]] = {}  # where in the stack the elements of a tag are
    blocks: list[int] = []  # where in the stack the blocks are
    pending: list[str] = []
    anchors = 0

    def flush() -> None:
        nonlocal place
        if pending:
            text = " ".join(html.unescape("".join(pending)).split())
            pending.clear()
            if text:
                place += 1
                if block.runs:
                    block.runs.append((place, text))
                else:
                    block.runs = [(place, text)]

    def push(tag: str, node: Node | None) -> None:
        open_.setdefault(tag, []).append(len(stack))
        if node is not None:
            blocks.append(len(stack))
        stack.append((tag, node))

    def pop_to(index: int) -> None:
        nonlocal block, anchors
        while len(stack) > index:
            tag, node = stack.pop()
            open_[tag].pop()
            if node is not None:
                flush()
                blocks.pop()
                node.end = len(nodes)
                block = node.parent
            elif tag == "a":
                anchors = max(0, anchors - 1)

    def innermost(tags) -> int:
        """Where the innermost open element of some tags is, or -1."""
        return max((open_[t][-1] for t in tags if open_.get(t)), default=-1)

    at, end = 0, len(page)
    last = page.rfind(">")
    while at < end:
        m = _TAG.search(page, at) if at <= last else None
        text = page[at : m.start() if m else end]
        if text:
            pending.append(text)
            if anchors:
                block.link_chars += len(text)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            found = innermost((tag,))
            # an inline end tag does not leave its block
            if found >= 0 and (tag in BLOCK or not blocks or found >= blocks[-1]):
                pop_to(found)
            continue
        if tag == "br":
            pending.append(" ")
            continue
        if tag in BLOCK:
            if tag in CLOSES_P:
                found = innermost(("p",))
                if found > innermost(P_SCOPES):
                    pop_to(found)
            if tag in ENDS_BEFORE:
                found = innermost(ENDS_BEFORE[tag])
                if found > innermost(SCOPES[tag]):
                    pop_to(found)
            if tag in ("html", "body", "head") and open_.get(tag):
                continue
            if tag == "body" and open_.get("head"):
                pop_to(open_["head"][0])
            flush()
            node = Node(tag, attribute_tokens(m[3]) if m[3] else (), block, len(nodes))
            block.n_children += 1
            nodes.append(node)
            if tag in VOID or m[3].rstrip().endswith("/") and tag in ("svg", "math"):
                node.end = len(nodes)
                continue
            push(tag, node)
            block = node
            if tag in RAW:
                close = re.compile(rf"</{tag}\s*/?>", re.I).search(page, at)
                stop = close.start() if close else end
                if tag == "title":
                    pending.append(page[at:stop])
                at = close.end() if close else end
                pop_to(len(stack) - 1)
        else:
            block.inline += 1
            if tag not in VOID:
                push(tag, None)
                if tag == "a":
                    anchors += 1
                    block.links += 1
    pop_to(0)
    flush()
    nodes[0].end = len(nodes)
    return nodes
