"""Chat formatting of typed content parts.

A turn's content is a list of parts of type text, image, audio or document. ``Flatten`` visits them in order: text is
escaped and kept; every other part becomes a numbered placeholder, with an attachment reference and the number of tokens
that it will expand to. The template marks turns with ``<|turn|>role`` and ``<|end|>``; inside texts a backslash breaks up
every control string (and doubles backslashes), so the output can be read back exactly. Text under the loss mask is that of
the assistant's turns.

``format_turns`` works row by row, without a shuffle. ``digests`` reads formatted turns back, conversation by conversation,
from sorted partitions with running hashes, so a conversation of any number of turns needs no more memory than one batch.

Defined results: null texts and roles are empty; a null conv_id is a conversation of its own; turns with the same number
stand in order of role, then text; repeated rows are turns of their own; an empty table gives no conversations; extra
columns are ignored. A null part is left out, a part without a type is text (texts that follow each other are one), a part
of any other type gets a placeholder of kind "other" and no tokens. Texts read back, also under the mask, are without the
placeholders; ``read_back`` tells where those stand.
"""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL = re.compile(r"<(?=\||/?s>)|\[(?=/?INST\])")
HEAD, TAIL = "<|turn|>", "<|end|>\n"
PLACEHOLDER = "<|{kind}:{n}|>"
MARK = re.compile(r"<\|([a-z]+):([0-9]+)\|>")
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


class Flatten:
    """Visits one turn's parts. Tokens: an image has one for each ``patch`` x ``patch`` square begun, audio ``per_second``
    for each second, a document ``per_page`` for each page; text is counted later, by the tokenizer."""

    def __init__(self, patch: int = 14, per_second: int = 25, per_page: int = 256):
        self.patch, self.per_second, self.per_page = patch, per_second, per_page
        self.out, self.refs, self.size, self.held = [], [], 0, []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.held.append(part.get("text") or "")  # escaped with the texts that follow: together they may form a control string

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, -(-(part.get("width") or 0) // self.patch) * -(-(part.get("height") or 0) // self.patch))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, round((part.get("seconds") or 0) * self.per_second))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, (part.get("pages") or 0) * self.per_page)

    def visit_other(self, part: dict) -> None:
        self.attach("other", part, 0)

    def close_text(self) -> None:
        text = escape("".join(self.held))
        self.held.clear()
        self.out.append(text)
        self.size += len(text)

    def content(self) -> str:
        self.close_text()
        return "".join(self.out)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.close_text()
        mark = PLACEHOLDER.format(kind=kind, n=len(self.refs))
        self.refs.append({"kind": kind, "ref": part.get("ref"), "at": self.size, "tokens": tokens})
        self.out.append(mark)
        self.size += len(mark)


def format_turns(turns: DataFrame) -> DataFrame:
    """``turns``: conv_id, turn, role, parts (as PARTS). Adds formatted, loss_start and loss_end (code points in it; equal
    outside the mask), attachments (places are in the turn's content) and attachment_tokens."""
    kept = turns.select("conv_id", "turn", "role", "parts")
    refs = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]))

    def run(batches):
        for batch in batches:
            formatted, start, end, attached, tokens = [], [], [], [], []
            for role, parts in zip(batch.column("role").to_pylist(), batch.column("parts").to_pylist()):
                visitor = Flatten()
                for part in parts or []:
                    if part is not None:
                        visitor.visit(part)
                head = f"{HEAD}{escape_role(role or '')}\n"
                content = visitor.content()
                formatted.append(f"{head}{content}{TAIL}")
                start.append(len(head))
                end.append(len(head) + (len(content) if role == "assistant" else 0))
                attached.append(visitor.refs)
                tokens.append(sum(r["tokens"] for r in visitor.refs))
            more = [pa.array(formatted, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(attached, refs), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("conv_id", "turn", "role")] + more, ["conv_id", "turn", "role", "formatted", "loss_start", "loss_end", "attachments", "attachment_tokens"])

    schema = "conv_id long, turn long, role string, formatted string, loss_start long, loss_end long, attachments array<struct<kind:string,ref:string,at:long,tokens:long>>, attachment_tokens long"
    return kept.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "parts").mapInArrow(run, schema)


def plain_text(content: str) -> str:
    """The text of formatted content, unescaped, without its placeholders (``MARK`` has two groups)."""
    return "".join(unescape(piece) for piece in MARK.split(content)[::3])


def content_of(formatted: str) -> tuple[str, str]:
    """Role and content of one formatted turn. No text holds a control string, so the ends are where they stand."""
    line = formatted.index("\n")
    if not (formatted.startswith(HEAD) and formatted.endswith(TAIL)):
        raise ValueError("not a formatted turn")
    return unescape_role(formatted[len(HEAD) : line]), formatted[line + 1 : -len(TAIL)]


def read_back(formatted: str) -> tuple[str, str, list[tuple[str, int, int]]]:
    """Role, text and attachments (kind, number, code points of text before it) of one formatted turn."""
    role, content = content_of(formatted)
    pieces = MARK.split(content)
    texts, found, before = [unescape(x) for x in pieces[::3]], [], 0
    for text, kind, number in zip(texts, pieces[1::3], pieces[2::3]):
        before += len(text)
        found.append((kind, int(number), before))
    return role, "".join(texts), found


def digests(formatted: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per conversation, read back from its formatted turns."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        conv, state, done = None, None, []

        def close():
            if state:
                done.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
                if not state or row[0] != conv:
                    close()
                    conv, state = row[0], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, content = content_of(row[1])
                text, loss = plain_text(content), plain_text(row[1][row[2] : row[3]])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(row[1])
            if len(done) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names)
                done.clear()
        close()
        if done:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), kinds)], names)

    slim = formatted.select("conv_id", "turn", "role", "formatted", "loss_start", "loss_end")
    dealt = slim.repartition("conv_id") if parts is None else slim.repartition(parts, "conv_id")
    ordered = dealt.sortWithinPartitions("conv_id", "turn", "role", "formatted").drop("turn", "role")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
