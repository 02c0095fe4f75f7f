"""Markdown to chunks: sections by headers, then pieces of bounded size that keep code fences whole."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_HEADER = re.compile(r"^(#{1,4})[ \t]+(.*?)[ \t]*#*[ \t]*$")
_FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})")


@dataclass
class Section:
    headers: dict[int, str] = field(default_factory=dict)
    lines: list[str] = field(default_factory=list)
    bare: bool = True  # holds nothing but header lines so far


def sections(text: str, depth: int = 4) -> list[Section]:
    """Sections by headers up to depth, their header lines kept. A header resets the deeper levels; lines inside code
    fences are no headers; a header that a deeper one follows directly goes into the deeper one's section."""
    out, now, fence, stack = [], Section(), "", {}
    for line in text.split("\n"):
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line.strip().strip(mark[1][0]):
                fence = ""
        elif mark:
            fence = mark[1]
        header = None if fence or mark else _HEADER.match(line)
        if header and len(header[1]) <= depth:
            level = len(header[1])
            deeper = now.bare and now.headers and level > max(now.headers)
            stack = {k: v for k, v in stack.items() if k < level} | {level: header[2]}
            if not deeper:
                out.append(now)
                now = Section()
            now.headers = dict(stack)
            now.lines.append(line)
            continue
        now.bare = now.bare and not line.strip()
        now.lines.append(line)
    out.append(now)
    return [s for s in out if any(x.strip() for x in s.lines)]


def _blocks(lines: list[str]) -> list[tuple[str, bool]]:
    """Runs of lines: (text, is it a code fence). Blank lines end a paragraph and stay with it."""
    out, run, fence = [], [], ""
    for line in lines:
        mark = _FENCE.match(line)
        if fence:
            run.append(line)
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line.strip().strip(mark[1][0]):
                out.append(("\n".join(run), True))
                run, fence = [], ""
            continue
        if mark:
            if run:
                out.append(("\n".join(run), False))
            run, fence = [line], mark[1]
        elif line.strip():
            if run and not run[-1].strip():
                out.append(("\n".join(run), False))
                run = []
            run.append(line)
        elif run:
            run.append(line)
    if run:
        out.append(("\n".join(run) + (f"\n{fence}" if fence else ""), bool(fence)))
    return out


def _pieces(text: str, size: int) -> list[str]:
    """A paragraph as pieces of at most size characters, cut at line ends, sentence ends, spaces, or anywhere."""
    out, at = [], 0
    while len(text) - at > size:
        window = text[at : at + size + 1]
        cut = 0
        for mark in ("\n", ". ", " "):
            found = window.rfind(mark, size // 4)
            if found > 0:
                cut = min(size, found + len(mark))
                break
        cut = cut or size
        out.append(text[at : at + cut])
        at += cut
    out.append(text[at:])
    return [p for p in out if p.strip()]


def chunks(text: str | None, chunk_size: int = 1500, overlap: int = 200) -> list[tuple[dict[int, str], str]]:
    """(headers by level, content) of each chunk of a document, in order.

    No chunk is longer than chunk_size but for a code fence that is longer itself. A chunk may begin with the end of
    the text before it in its section, at most overlap characters, never a part of a fence."""
    out = []
    for s in sections(text or ""):
        units = [(p, fenced) for block, fenced in _blocks(s.lines) for p in ([block] if fenced else _pieces(block, chunk_size))]
        now, size, fresh = [], 0, False
        for unit, fenced in units:
            if fresh and size + 1 + len(unit) > chunk_size:
                out.append((s.headers, "\n".join(now).strip("\n")))
                tail = "" if now[-1:] and _FENCE.match(now[-1]) else _tail(now[-1] if now else "", min(overlap, chunk_size - len(unit) - 1))
                now, size, fresh = ([tail], len(tail), False) if tail else ([], 0, False)
            now.append(unit)
            size += len(unit) + (len(now) > 1)
            fresh = True
        if fresh and (content := "\n".join(now).strip("\n")).strip():
            out.append((s.headers, content))
    return out


def _tail(text: str, room: int) -> str:
    """The last words of a text without fence marks, room characters at most."""
    text = text.rstrip()
    if room <= 0 or "```" in text or "~~~" in text:
        return ""
    if len(text) <= room:
        return text
    cut = text[-room:]
    at = cut.find(" ")
    return cut[at + 1 :] if 0 <= at < len(cut) - 1 else ""
