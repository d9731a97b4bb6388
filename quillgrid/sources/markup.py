"""Markdown, HTML, plain text, text outlines and lenient XML as pure functions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_ENTITY = re.compile(r"&(?:(amp|lt|gt|quot|apos)|#([0-9]{1,7})|#[xX]([0-9A-Fa-f]{1,6}));")


def decode_entities(text: str) -> str:
    """Five named and the numeric entities, each on its own; anything else stays as it is."""

    def one(m: re.Match) -> str:
        if m.group(1):
            return _NAMED[m.group(1)]
        code = int(m.group(2)) if m.group(2) else int(m.group(3), 16)
        return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else m.group()

    return _ENTITY.sub(one, text)


def encode_entities(text: str, attribute: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return text.replace('"', "&quot;").replace("'", "&apos;") if attribute else text


def html_text(text: str) -> str:
    for a, b in (("<br>", "\n"), ("<br/>", "\n"), ("<br />", "\n"), ("</p>", "\n\n"), ("</div>", "\n"), ("<li>", "- "), ("</li>", "\n"), ("</h1>", "\n\n"), ("</h2>", "\n\n"), ("</h3>", "\n\n")):
        text = text.replace(a, b)
    return decode_entities(re.sub(r"(?s)<[^>]*(>|\Z)", "", text).replace(">", ""))


def paragraphs(text: str) -> list[str]:
    return [p for part in text.split("\n\n") if (p := part.strip())]


_INLINE = re.compile(r"\*\*(?P<bold>.+?)\*\*|\*(?P<italic>[^*]+)\*|`(?P<code>[^`]+)`|\[(?P<label>[^\]]*)\]\((?P<url>[^)]*)\)", re.S)


def inline_spans(text: str) -> list[dict]:
    """Runs of a paragraph: text, bold, italic, code and link; marks without an end are plain text."""
    out, at = [], 0
    for m in _INLINE.finditer(text):
        if m.start() > at:
            out.append({"kind": "text", "text": text[at : m.start()], "url": None})
        kind = m.lastgroup if m.lastgroup in ("bold", "italic", "code") else "link"
        out.append({"kind": kind, "text": m.group("label") if kind == "link" else m.group(kind), "url": m.group("url") if kind == "link" else None})
        at = m.end()
    if at < len(text):
        out.append({"kind": "text", "text": text[at:], "url": None})
    return out


def _table_row(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def markdown_blocks(text: str) -> list[dict]:
    """Headings, rules, lists, pipe tables and paragraphs; the lines of a paragraph are joined by a space."""
    out: list[dict] = []
    lines = text.split("\n")
    at = 0
    while at < len(lines):
        line = lines[at].strip()
        heading = re.fullmatch(r"(#{1,6})(?!#)\s*(\S.*)", line)
        if not line:
            at += 1
        elif heading:
            out.append({"kind": "heading", "level": len(heading.group(1)), "spans": inline_spans(heading.group(2))})
            at += 1
        elif line in ("---", "***"):
            out.append({"kind": "rule"})
            at += 1
        elif re.match(r"[-*] |[0-9]+\. ", line):
            ordered = line[0].isdigit()
            items = []
            while at < len(lines) and (m := re.match(r"\s*[0-9]+\.\s+(.*)" if ordered else r"\s*[-*]\s+(.*)", lines[at])):
                items.append(inline_spans(m.group(1).strip()))
                at += 1
            out.append({"kind": "list", "ordered": ordered, "items": items})
        elif line.startswith("|") and line.endswith("|") and len(line) > 1:
            rows = []
            while at < len(lines) and (row := lines[at].strip()).startswith("|"):
                cells = _table_row(row)
                if not all(re.fullmatch(r":?-{1,}:?", c) for c in cells):
                    rows.append(cells)
                at += 1
            out.append({"kind": "table", "rows": rows})
        else:
            part = []
            while at < len(lines) and (s := lines[at].strip()) and not re.match(r"#{1,6}(?!#)\s*\S|[-*] ", s) and s not in ("---", "***") and not (s.startswith("|") and s.endswith("|")):
                part.append(s)
                at += 1
            if not part:  # a line that begins like a block but is none
                part.append(line)
                at += 1
            out.append({"kind": "paragraph", "spans": inline_spans(" ".join(part))})
    return out


def _plain_spans(spans: list[dict]) -> str:
    return "".join("\n" if s["kind"] == "line_break" else s["text"] or "" for s in spans)


def plain(block: dict) -> str:
    """Plain text of a block."""
    kind = block["kind"]
    if kind == "list":
        return "\n".join(f"{f'{k + 1}.' if block.get('ordered') else '-'} {_plain_spans(i)}" for k, i in enumerate(block["items"]))
    if kind == "table":
        return "\n".join("\t".join(r) for r in block["rows"])
    return _plain_spans(block.get("spans", [])) if kind in ("heading", "paragraph", "code") else ""


_SPECIAL = re.compile(r"([\\*_\[\]`])")


def _markdown_spans(spans: list[dict]) -> str:
    wrap = {"bold": "**{}**", "italic": "*{}*"}
    out = []
    for s in spans:
        text = s["text"] or ""
        if s["kind"] == "line_break":
            out.append("  \n")
        elif s["kind"] == "code":
            out.append(f"`{text}`")
        elif s["kind"] == "link":
            out.append(f"[{_SPECIAL.sub(r'\\\1', text)}]({s['url'] or ''})")
        else:
            out.append(wrap.get(s["kind"], "{}").format(_SPECIAL.sub(r"\\\1", text)))
    return "".join(out)


def to_markdown(blocks: list[dict], title: str | None = None) -> str:
    out = [f"# {title}"] if title else []
    for b in blocks:
        kind = b["kind"]
        if kind == "heading":
            out.append(f"{'#' * max(1, min(6, b.get('level') or 1))} {_markdown_spans(b['spans'])}")
        elif kind == "list":
            out.append("\n".join(f"{f'{k + 1}.' if b.get('ordered') else '-'} {_markdown_spans(i)}" for k, i in enumerate(b["items"])))
        elif kind == "table":
            if b["rows"]:
                escape = lambda r: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in r) + " |"
                out.append("\n".join([escape(b["rows"][0]), "|" + " --- |" * len(b["rows"][0]), *map(escape, b["rows"][1:])]))
        elif kind == "code":
            out.append(f"```\n{_plain_spans(b['spans'])}\n```")
        elif kind in ("rule", "page_break"):
            out.append("---")
        else:
            out.append(_markdown_spans(b["spans"]))
    return "\n\n".join(out) + "\n"


def _html_spans(spans: list[dict]) -> str:
    wrap = {"bold": "<strong>{}</strong>", "italic": "<em>{}</em>", "code": "<code>{}</code>"}
    out = []
    for s in spans:
        text = encode_entities(s["text"] or "")
        if s["kind"] == "line_break":
            out.append("<br/>")
        elif s["kind"] == "link":
            out.append(f'<a href="{encode_entities(s["url"] or "", True)}">{text}</a>')
        else:
            out.append(wrap.get(s["kind"], "{}").format(text))
    return "".join(out)


def to_html(blocks: list[dict], title: str = "") -> str:
    out = []
    for b in blocks:
        kind = b["kind"]
        if kind == "heading":
            n = max(1, min(6, b.get("level") or 1))
            out.append(f"<h{n}>{_html_spans(b['spans'])}</h{n}>")
        elif kind == "list":
            tag = "ol" if b.get("ordered") else "ul"
            out.append(f"<{tag}>" + "".join(f"<li>{_html_spans(i)}</li>" for i in b["items"]) + f"</{tag}>")
        elif kind == "table":
            out.append("<table>" + "".join("<tr>" + "".join(f"<td>{encode_entities(c)}</td>" for c in r) + "</tr>" for r in b["rows"]) + "</table>")
        elif kind == "code":
            out.append(f"<pre><code>{encode_entities(_plain_spans(b['spans']))}</code></pre>")
        elif kind in ("rule", "page_break"):
            out.append("<hr/>")
        else:
            out.append(f"<p>{_html_spans(b['spans'])}</p>")
    return f'<!doctype html><html><head><meta charset="utf-8"/><title>{encode_entities(title)}</title></head><body>{"".join(out)}</body></html>'


def outline_slides(text: str) -> list[tuple[int, str, str]]:
    """Slides of a text outline: '# ' begins one, '- ' is a bullet, anything else a text box."""
    out, slide = [], 0
    for line in text.split("\n"):
        s = line.strip()
        if s.startswith("#"):
            slide += 1
            out.append((slide, "title", s.lstrip("#").strip()))
        elif s:
            slide = slide or 1
            out.append((slide, "bullet", s[2:].strip()) if s.startswith(("- ", "* ")) else (slide, "text_box", s))
    return out


_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<\?.*?(?:\?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<!.*?(?:>|\Z)|</(?P<end>[^>\s]+)\s*>|<(?P<start>[^>\s/]+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?P<empty>/?)>|(?P<text>[^<]+)|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=]+)\s*=\s*(\"[^\"]*\"|'[^']*')")


def lenient_xml(text: str) -> ET.Element:
    """A tree of what a strict parser refuses: open elements are closed at the end, an end tag closes the
    nearest open element of its local name, stray ones are skipped. Prefixes are kept apart as names."""
    holder = ET.Element("holder")
    stack = [holder]

    def add(value: str) -> None:
        top = stack[-1]
        if len(top):
            top[-1].tail = (top[-1].tail or "") + value
        else:
            top.text = (top.text or "") + value

    for m in _MARKUP.finditer(text):
        if m.group("cdata") is not None:
            add(m.group("cdata"))
        elif m.group("end"):
            name = m.group("end").rpartition(":")[2]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag.rpartition("}")[2] == name:
                    del stack[k:]
                    break
        elif m.group("start"):
            prefix, _, name = m.group("start").rpartition(":")
            node = ET.SubElement(stack[-1], f"{{{prefix}}}{name}" if prefix else name, {(f"{{{p}}}{n}" if p else n): decode_entities(v[1:-1]) for k, v in _ATTRIBUTE.findall(m.group("attrs")) for p, _, n in (k.rpartition(":"),)})
            if not m.group("empty"):
                stack.append(node)
        elif m.group("text"):
            add(decode_entities(m.group("text")))
    return holder[0] if len(holder) else ET.Element("none")


# -- formulas of mathematics --------------------------------------------------------------------------------

_LATEX = re.compile(r"\\([A-Za-z]+|.)|([{}^_])|([0-9.]+)|([A-Za-z])|(\s+)|(.)", re.S)
#: Commands that stand for one character.
SYMBOLS = {"alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "theta": "θ", "lambda": "λ", "mu": "μ", "pi": "π", "sigma": "σ", "phi": "φ", "omega": "ω", "infty": "∞", "times": "×", "cdot": "·", "pm": "±", "leq": "≤", "geq": "≥", "neq": "≠", "sum": "∑", "int": "∫"}


def parse_latex(text: str) -> tuple:
    """Tree of a formula: ('row', ...), ('frac', a, b), ('sqrt', a), ('sup', a, b), ('sub', a, b), ('num'|'id'|'op', s)."""
    tokens = [m.groups() for m in _LATEX.finditer(text) if m.group(5) is None]
    at = 0

    def group() -> tuple:
        nonlocal at
        if at < len(tokens) and tokens[at][1] == "{":
            at += 1
            out = row("}")
            at += 1
            return out
        return atom()

    def atom() -> tuple:
        nonlocal at
        if at >= len(tokens):
            return ("row",)
        command, mark, digits, letter, _, other = tokens[at]
        at += 1
        if command == "frac":
            a = group()
            return ("frac", a, group())
        if command == "sqrt":
            return ("sqrt", group())
        if command is not None:
            return ("op" if command in ("times", "cdot", "pm", "leq", "geq", "neq", "sum", "int") or not command.isalpha() else "id", SYMBOLS.get(command, command))
        if mark == "{":
            at -= 1
            return group()
        if digits:
            return ("num", digits)
        return ("id", letter) if letter else ("op", mark or other)

    def row(end: str | None) -> tuple:
        nonlocal at
        out: list[tuple] = []
        while at < len(tokens) and not (end and tokens[at][1] == end):
            if tokens[at][1] in ("^", "_"):
                kind = "sup" if tokens[at][1] == "^" else "sub"
                at += 1
                base = out.pop() if out else ("row",)
                out.append((kind, base, group()))
            elif tokens[at][1] == "}":
                at += 1
            else:
                out.append(atom())
        return out[0] if len(out) == 1 else ("row", *out)

    return row(None)


def mathml(node: tuple) -> str:
    kind = node[0]
    if kind in ("num", "id", "op"):
        tag = {"num": "mn", "id": "mi", "op": "mo"}[kind]
        return f"<{tag}>{encode_entities(node[1])}</{tag}>"
    tag = {"row": "mrow", "frac": "mfrac", "sqrt": "msqrt", "sup": "msup", "sub": "msub"}[kind]
    return f"<{tag}>{''.join(map(mathml, node[1:]))}</{tag}>"


def flat_math(node: tuple) -> str:
    kind = node[0]
    if kind in ("num", "id", "op"):
        return node[1]
    parts = [flat_math(x) for x in node[1:]]
    return {"row": "".join(parts), "frac": "({})/({})", "sqrt": "sqrt({})", "sup": "{}^{}", "sub": "{}_{}"}[kind].format(*parts) if kind != "row" else "".join(parts)


_MATH_TAGS = {"mn": "num", "mi": "id", "mo": "op", "mtext": "id", "mfrac": "frac", "msqrt": "sqrt", "msup": "sup", "msub": "sub"}


def math_tree(node: ET.Element) -> tuple:
    """Tree of MathML, as ``parse_latex`` gives it; elements unknown here are rows of what they hold, annotations are left out."""
    kind = _MATH_TAGS.get(node.tag.rpartition("}")[2].rpartition(":")[2], "row")
    if kind in ("num", "id", "op"):
        return kind, "".join(node.itertext()).strip()
    parts = [math_tree(x) for x in node if not x.tag.rpartition("}")[2].startswith("annotation")]
    if kind in ("frac", "sup", "sub"):
        return kind, *(parts + [("row",), ("row",)])[:2]
    if kind == "sqrt":
        return "sqrt", parts[0] if len(parts) == 1 else ("row", *parts)
    return parts[0] if len(parts) == 1 else ("row", *parts)


def parse_mathml(text: str) -> tuple:
    return math_tree(lenient_xml(text))
