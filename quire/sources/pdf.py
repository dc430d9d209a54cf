"""PDF files as a source: the text of their pages, by a small reader of page content.

It reads documents whose content is plain or deflated and whose strings are in a Latin encoding or have a ToUnicode map;
scanned pages have no text, and encrypted files are refused.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "path string, page_no int, text string"
OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"stream\r?\n")
REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s/<>\[\]()]+|[-+.\d]+|\[|\]|[A-Za-z'\"*]+", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Document:
    """A file's objects; ``pages`` gives each page's text in order."""

    def __init__(self, data: bytes):
        if not data.lstrip()[:5] == b"%PDF-":
            raise ValueError("not a PDF file")
        if b"/Encrypt" in data:
            raise ValueError("the file is encrypted")
        self.objects = {int(m[1]): m[2] for m in OBJECT.finditer(data)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body:
                self._unpack(body)

    def _unpack(self, body: bytes) -> None:
        """The objects inside a stream of objects."""
        content = self.stream(body)
        n, first = (int(re.search(rb"/%s\s+(\d+)" % k, body)[1]) for k in (b"N", b"First"))
        heads = list(map(int, content[:first].split()))[: 2 * n]
        places = [*heads[1::2], len(content) - first]
        for number, a, b in zip(heads[::2], places, places[1:], strict=False):
            self.objects.setdefault(number, content[first + a : first + b])

    def stream(self, body: bytes) -> bytes:
        m = STREAM.search(body)
        if not m:
            return b""
        raw = body[m.end() : body.rfind(b"endstream")]
        if b"/FlateDecode" in body[: m.start()]:
            return zlib.decompressobj().decompress(raw)
        return raw

    def part(self, body: bytes, name: bytes) -> bytes:
        """What a name in a dictionary refers to, or holds itself."""
        m = re.search(rb"/%s\s*(\d+\s+\d+\s+R|<<.*?>>|\[.*?\])" % name, body, re.S)
        if not m:
            return b""
        ref = REFERENCE.fullmatch(m[1])
        return self.objects.get(int(ref[1]), b"") if ref else m[1]

    def order(self) -> list[bytes]:
        """The pages in the order of the page tree."""
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
        out: list[bytes] = []
        todo, seen = [self.part(root, b"Pages")], set()
        while todo:
            body = todo.pop()
            if re.search(rb"/Type\s*/Page\b", body):
                out.append(body)
                continue
            kids = [int(x) for x in REFERENCE.findall(self.part(body, b"Kids"))]
            todo += [self.objects.get(k, b"") for k in reversed(kids) if k not in seen]
            seen.update(kids)
        return out or [b for b in self.objects.values() if re.search(rb"/Type\s*/Page\b", b)]

    def pages(self) -> Iterator[str]:
        for body in self.order():
            m = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", body, re.S)
            refs = [int(x) for x in REFERENCE.findall(m[1])] if m else []
            listed = self.objects.get(refs[0], b"") if len(refs) == 1 else b""
            if listed.strip().startswith(b"["):
                refs = [int(x) for x in REFERENCE.findall(listed)]
            fonts = dict(re.findall(rb"/(\S+)\s+(\d+)\s+\d+\s+R", self.part(self.part(body, b"Resources") or body, b"Font")))
            maps = {name: self.unicode_map(self.objects.get(int(n), b"")) for name, n in fonts.items()}
            yield shown(b"\n".join(self.stream(self.objects.get(r, b"")) for r in refs), maps)

    def unicode_map(self, font: bytes) -> dict[int, str]:
        """A font's codes to text, by its ToUnicode map; the key -1 holds how many bytes a code has."""
        content = self.stream(self.part(font, b"ToUnicode"))
        text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
        out: dict[int, str] = {}
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", content, re.S):
            for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                out[int(code, 16)], out[-1] = text(to), str(len(code) // 2)
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", content, re.S):
            for a, b, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                first = text(to)
                for i in range(int(b, 16) - int(a, 16) + 1):
                    out[int(a, 16) + i] = first[:-1] + chr(ord(first[-1]) + i)
                out[-1] = str(len(a) // 2)
        return out


def string_bytes(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else ESCAPES.get(m[1], b"" if m[1] in (b"\n", b"\r\n") else m[1]), token[1:-1], flags=re.S)


def shown(content: bytes, maps: dict[bytes, dict[int, str]]) -> str:
    """The text that a page's content shows: a new line where the text moves down, a space for a wide gap."""
    out: list[str] = []
    stack: list[bytes] = []
    font: dict[int, str] = {}

    def say(token: bytes) -> str:
        data = string_bytes(token)
        if not font:
            return data.decode("cp1252", "replace")
        n = int(font[-1])
        return "".join(font.get(int.from_bytes(data[i : i + n], "big"), "") for i in range(0, len(data), n))

    for m in TOKEN.finditer(content):
        t = m[0]
        if t[:1] in b"(</[]+-.0123456789":
            stack.append(t)
            continue
        strings = [x for x in stack if x[:1] in b"(<"]
        if t == b"Tf" and len(stack) >= 2:
            font = maps.get(stack[-2][1:], {})
        elif t in (b"Tj", b"TJ"):
            out += [say(x) if x[:1] in b"(<" else " " if x[:1] in b"+-.0123456789" and float(x) < -200 else "" for x in stack]
        elif t in (b"'", b'"'):
            out += ["\n", *map(say, strings)]
        elif t == b"T*" or t in (b"Td", b"TD") and len(stack) >= 2 and float(stack[-1]) != 0 or t == b"Tm":
            out.append("\n")
        elif t == b"ET":
            out.append("\n")
        stack = []
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(out))).strip()


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [(path, i, text.replace("\r\n", "\n").replace("\r", "\n")) for path, data in zip(frame["path"], frame["content"], strict=True) for i, text in enumerate(Document(bytes(data)).pages())]
        yield pd.DataFrame(rows, columns=["path", "page_no", "text"])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_no, text) of the PDF files in a folder, or of one."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content").mapInPandas(_read, PAGES)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): the pages that have text, a blank line between them."""
    pages = read_pages(spark, path).filter(F.trim("text") != "")
    parts = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return pages.groupBy("path").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))
