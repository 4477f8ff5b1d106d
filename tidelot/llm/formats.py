"""What texts in self-describing formats announce: lines of a hunk, files of a change, lines of a message.

A unified diff states how many lines each hunk has, a binary line its length, a log entry the lines
of its message. A text that ends before what it announced is unfinished, one that ends with it is whole,
whatever its last word is. Texts in other formats announce nothing.
"""

from __future__ import annotations

import re

# Lines of unified diffs, binary patches and log entries.
HUNK = re.compile(r"^@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@")
FILES = ("diff --git ", "Index: ")
# Lines of a file's header behind its first; lines that are a change by themselves, whatever else follows; how lines begin that a cut may leave unfinished.
HEADER = re.compile(r"^(?:index |--- |\+\+\+ |=+$|(?:old|new|new file|deleted file) mode |(?:dis)?similarity index |(?:rename|copy) (?:from|to) )")
CHANGE = re.compile(r"^(?:Binary files .*differ$|Files .* differ$|GIT binary patch$|Cannot display: .*\.$|Property changes on: .)")
NEW_MODE = re.compile(r"new mode \d{6}$|={67}$")
EMPTY_FILE = re.compile(r"^index (?:0{7,}\.\.e69de29|e69de29[0-9a-f]*\.\.0{7})")
BEGINNINGS = ("index ", "--- ", "+++ ", "old mode ", "new mode ", "new file mode ", "deleted file mode ", "similarity index ", "dissimilarity index ", "rename from ", "copy from ", "Binary files ", "GIT binary patch", "@@ -")
MESSAGE_LINES = re.compile(r"^r\d+ \|[^\n]*\| (\d+) lines?$")


def whole_change(line: str, file: str) -> bool:
    """Whether a header line of `file` (its first line) can be the last of its file: a new mode, name or an empty file."""
    if line.startswith(("rename to ", "copy to ")):
        return file.endswith(line.split(" to ", 1)[1])
    return bool(EMPTY_FILE.match(line) if line[:1] == "i" else NEW_MODE.match(line))


def announced(text: str) -> tuple[int, bool, bool, list[str], bool]:
    """What a text announces: changed files shown, whether something is missing at the end, whether it ends with a whole hunk, the lines outside of hunks, and whether the last file shows a change that is whole."""
    lines = text.split("\n")
    if not lines[-1]:
        lines.pop()
    files, old, new, binary, inside, outside = 0, 0, 0, False, False, []
    file, header, change = "", False, False  # first line of the last file, whether its header still goes on, whether it shows a change
    for line in lines:
        if old > 0 or new > 0:
            sign = line[:1]
            if sign == "-" and old > 0:
                old -= 1
                continue
            if sign == "+" and new > 0:
                new -= 1
                continue
            if sign in (" ", "") and old > 0 and new > 0:
                old, new = old - 1, new - 1
                continue
            if sign == "\\":
                continue
        elif inside and line[:1] == "\\":
            continue
        inside = False
        outside.append(line)
        if line[:3] == "@@ " and (m := HUNK.match(line)):
            old, new, binary, inside = int(m[1] or 1), int(m[2] or 1), False, True
            header, change = False, True
        elif line.startswith(FILES):
            files, old, new, binary = files + 1, 0, 0, False
            file, header, change = line, True, False
        else:
            if line.startswith("GIT binary patch"):
                binary = True
            elif old > 0 or new > 0:  # something else follows the hunk: it was counted differently, not cut
                old = new = 0
            if header and line.strip():
                if CHANGE.match(line):
                    header, change = False, True
                elif HEADER.match(line):
                    change = whole_change(line, file)
                else:
                    header = False
    end = next((x for x in reversed(lines) if x.strip()), "")
    cut_header = files > 0 and not change and (header or end.startswith("Binary files ") or any(b.startswith(end) for b in BEGINNINGS))
    cut_hunk = files > 0 and not inside and end.startswith("@@ -") and not HUNK.match(end)
    missing = old > 0 or new > 0 or cut_header or cut_hunk
    if binary and lines:
        last = lines[-1]
        if last[:1].isalpha() and last[:1].isascii() and len(last) < 80 and not last.startswith(("literal", "delta", "index", "GIT")):
            n = ord(last[0]) - 64 if last[0] <= "Z" else ord(last[0]) - 70
            missing = missing or len(last) - 1 < -(-n // 4) * 5
    if lines and (m := MESSAGE_LINES.match(lines[0])) and not missing and files == 0:
        missing = len(lines) - 2 < int(m[1])
    return files, missing, inside and not missing, outside, change and not missing
