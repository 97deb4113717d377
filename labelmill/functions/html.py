"""Comment blocks of an HTML page, found with the standard library's streaming parser."""

from __future__ import annotations

from dataclasses import dataclass, field
from html.parser import HTMLParser

# Elements without an end tag.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)


@dataclass(frozen=True)
class BlockSpec:
    """Which elements make a block and its parts.  ``*_class`` tests are substring tests on the
    class attribute; ``body_class`` is a whole class name."""

    block_tag: str = "div"
    block_class: str = "comment"
    author_tag: str = "a"
    author_class: str = "author"
    body_class: str = "md"
    own_only: bool = False


@dataclass
class Block:
    depth: int
    author: list[str] | None = None
    author_open: bool = False
    paragraphs: list[list[str]] = field(default_factory=list)
    code: list[str] | None = None
    code_open: bool = False

    def row(self) -> tuple:
        joined = ["".join(p) for p in self.paragraphs]
        return (
            None if self.author is None else "".join(self.author),
            "\n".join(joined),
            None if self.code is None else "".join(self.code),
        )


class _BlockParser(HTMLParser):
    """Keeps the stack of open elements and hands text to every open block it belongs to."""

    def __init__(self, spec: BlockSpec) -> None:
        super().__init__(convert_charrefs=True)
        self.spec = spec
        self.stack: list[tuple[str, str]] = []
        self.open_blocks: list[Block] = []
        self.done: list[Block] = []
        self.text: list[str] = []
        self.open_p: list[int] = []

    def _targets(self) -> list[Block]:
        return self.open_blocks[-1:] if self.spec.own_only else self.open_blocks

    def flush(self) -> None:
        """One text node ends here; its stripped text goes to the parts that are open."""
        text = "".join(self.text).strip()
        self.text.clear()
        if not text:
            return
        for b in self._targets():
            if b.author_open and b.author is not None:
                b.author.append(text)
            if b.code_open and b.code is not None:
                b.code.append(text)
            if any(depth > b.depth for depth in self.open_p) and b.paragraphs:
                b.paragraphs[-1].append(text)

    def handle_data(self, data: str) -> None:
        self.text.append(data)

    def handle_comment(self, data: str) -> None:
        self.flush()

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_starttag(self, tag, attrs) -> None:
        self.flush()
        if tag in VOID:
            return
        spec, classes = self.spec, dict(attrs).get("class") or ""
        parent_classes = self.stack[-1][1].split() if self.stack else []
        self.stack.append((tag, classes))
        depth = len(self.stack)
        if tag == spec.block_tag and spec.block_class in classes:
            block = Block(depth)
            self.open_blocks.append(block)
            self.done.append(block)
        elif tag == spec.author_tag and spec.author_class in classes:
            for b in self._targets():
                if b.author is None:
                    b.author, b.author_open = [], True
        elif tag == "p" and spec.body_class in parent_classes:
            self.open_p.append(depth)
            for b in self._targets():
                b.paragraphs.append([])
        elif tag == "code" and self._inside_body_pre():
            for b in self._targets():
                if b.code is None:
                    b.code, b.code_open = [], True

    def _inside_body_pre(self) -> bool:
        """code within pre within an element of the body class."""
        body = pre = False
        for tag, classes in self.stack[:-1]:
            pre = pre or (body and tag == "pre")
            body = body or self.spec.body_class in classes.split()
        return pre

    def handle_endtag(self, tag) -> None:
        self.flush()
        if not any(open_tag == tag for open_tag, _ in self.stack):
            return
        while self.stack:
            depth = len(self.stack)
            closed, _ = self.stack.pop()
            if self.open_p and self.open_p[-1] == depth:
                self.open_p.pop()
            for b in self.open_blocks:
                if closed == self.spec.author_tag:
                    b.author_open = False
                if closed == "code":
                    b.code_open = False
            if self.open_blocks and self.open_blocks[-1].depth == depth:
                self.open_blocks.pop()
            if closed == tag:
                break


def page_blocks(html: str | None, spec: BlockSpec) -> list[tuple]:
    """(author, body, code) of every block of the page in document order."""
    parser = _BlockParser(spec)
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return [b.row() for b in parser.done]


# Elements before which a paragraph without end tag ends.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main "
    "menu nav ol p pre section table ul".split()
)


class _TextParser(HTMLParser):
    """The first h1, every p and the first li; an element left open ends with the element around it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, list[str] | None]] = []
        self.parts: dict[str, list[list[str]]] = {"h1": [], "p": [], "li": []}
        self.silent = 0

    def _close(self, depth: int) -> None:
        for tag, _ in self.stack[depth:]:
            self.silent -= tag in ("script", "style")
        del self.stack[depth:]

    def handle_data(self, data: str) -> None:
        if not self.silent:
            for _, texts in self.stack:
                if texts is not None:
                    texts.append(data)

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_starttag(self, tag, attrs) -> None:
        if tag in ENDS_P and "p" in (tags := [t for t, _ in self.stack]):
            self._close(tags.index("p"))
        if tag == "li":
            tags = [t for t, _ in self.stack]
            lists = [i for i, t in enumerate(tags) if t in ("ul", "ol", "menu")]
            items = [i for i, t in enumerate(tags) if t == "li" and i > (lists[-1] if lists else -1)]
            if items:
                self._close(items[0])
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            return
        texts: list[str] | None = [] if tag in self.parts else None
        if texts is not None:
            self.parts[tag].append(texts)
        self.silent += tag in ("script", "style")
        self.stack.append((tag, texts))

    def handle_endtag(self, tag) -> None:
        at = [i for i, (t, _) in enumerate(self.stack) if t == tag]
        if at:
            self._close(at[-1])


def page_text(html: str | None) -> tuple[str | None, str, str | None]:
    """(title, body, item) of the whole page: its first h1, its paragraphs joined by line ends, and its first li, white
    space at the ends removed; null where the page has no h1 or li."""
    parser = _TextParser()
    parser.feed(html or "")
    parser.close()
    h1, p, li = (["".join(x).strip() for x in parser.parts[tag]] for tag in ("h1", "p", "li"))
    return h1[0] if h1 else None, "\n".join(p), li[0] if li else None


class _LinkParser(HTMLParser):
    """Targets of the anchors inside an element, in document order."""

    def __init__(self, within: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.within, self.inside, self.found = within, 0, []

    def handle_starttag(self, tag, attrs) -> None:
        if tag == self.within:
            self.inside += 1
        elif tag == "a" and (self.within is None or self.inside):
            self.found += [value or "" for name, value in attrs if name == "href"][:1]

    def handle_endtag(self, tag) -> None:
        if tag == self.within and self.inside:
            self.inside -= 1


def page_links(html: str | None, within: str | None = "td") -> list[str]:
    """Targets of the page's anchors with character references decoded; ``within`` names the element they must be
    inside, None takes every anchor."""
    parser = _LinkParser(within)
    parser.feed(html or "")
    parser.close()
    return parser.found
