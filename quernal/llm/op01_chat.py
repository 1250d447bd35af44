"""Chat formatting: typed content parts, flattened into one prompt a conversation.

A message is (conv_id, turn, role, parts); a part has type ('text', 'image', 'audio', 'document'), text, uri, width and height in pixels,
seconds, and pages. A visitor has one method for each type, which gives the part's prompt text, token count and attachment reference
as columns; `flatten` lets it visit all parts where they stand, so the work stays in Spark's generated code.

A text part is its text, with "<|" broken up so that it can't forge a mark, and with a space before a "|" that begins a part after the message's first, so that
two parts can't either; its tokens are TEXT_BYTES UTF-8 bytes each, rounded up, unless the visitor is given another measure. In roles all but letters, digits and
"_.-" becomes "_"; in uris white space is written as %20 and so on, so neither can forge a mark or a line. An attachment becomes <|type_k|>, k counting the attachments of its type in the conversation from 0, and expands to:
an image, PATCH x PATCH pixel patches (at least LEAST_PATCHES, at most MOST_PATCHES) and two marks; audio, AUDIO_RATE tokens a second, rounded up;
a document, PAGE_TOKENS a page. A message is <|role|> line feed, its parts in order, <|end|> line feed; role and end marks count a token each.

Result: conv_id, prompt, attachments (one `k type uri tokens` a line, in order), n_messages, n_attachments, text_tokens, attachment_tokens, n_tokens.

Defined cases: messages go by turn (null first), then role, then parts as JSON, so ties and repeated rows, which all stay, have one order. A
null role is 'unknown'. Null or empty parts make an empty message. A part of null or unknown type is a text part with its text. Null texts and uris are
'', null or negative sizes 0. A null conv_id is a conversation of its own. An empty table gives an empty result. Extra columns aren't read.
The one shuffle is by conversation; a conversation is put together as one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PATCH, LEAST_PATCHES, MOST_PATCHES = 28, 4, 16384
AUDIO_RATE = 25
PAGE_TOKENS = 512
TEXT_BYTES = 4
KINDS = ("image", "audio", "document")


def text_tokens(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / TEXT_BYTES).cast("bigint")


def safe_role(role: Column) -> Column:
    """Letters, digits, '_', '.' and '-' of a role; anything else becomes '_', so that it can't end its mark."""
    return F.regexp_replace(F.coalesce(role.cast("string"), F.lit("unknown")), r"[^\p{L}\p{N}_.-]", "_")


def safe_uri(uri: Column) -> Column:
    """A uri without white space, which would end its field or line."""
    out = F.coalesce(uri, F.lit(""))
    for c, code in ((" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")):
        out = F.replace(out, F.lit(c), F.lit(code))
    return F.regexp_replace(out, r"[\p{Z}\p{C}]", "_")


class PartVisitor:
    """A method for each type of part, from the struct column `part` and its number `k` to a struct of shown (prompt text), tokens and line (reference, or null).

    Subclass it for other models: a new type is a new method and its name in `kinds`.
    """

    kinds: tuple[str, ...] = KINDS

    def __init__(self, tokens: Callable[[Column], Column] = text_tokens) -> None:
        self.tokens = tokens

    def size(self, x: Column) -> Column:
        return F.greatest(F.coalesce(x, F.lit(0)), F.lit(0))

    def attachment(self, kind: str, part: Column, k: Column, tokens: Column) -> Column:
        tokens = tokens.cast("bigint")
        line = F.concat_ws(" ", k.cast("string"), F.lit(kind), safe_uri(part["uri"]), tokens.cast("string"))
        return F.struct(F.format_string(f"<|{kind}_%d|>", k).alias("shown"), tokens.alias("tokens"), line.alias("line"))

    def text(self, part: Column, k: Column) -> Column:
        raw = F.coalesce(part["text"], F.lit(""))
        shown = F.replace(F.when(raw.startswith("|") & (F.col("p") > 0), F.concat(F.lit(" "), raw)).otherwise(raw), F.lit("<|"), F.lit("< |"))
        return F.struct(shown.alias("shown"), self.tokens(raw).alias("tokens"), F.lit(None).cast("string").alias("line"))

    def image(self, part: Column, k: Column) -> Column:
        patches = F.ceil(self.size(part["width"]) / PATCH) * F.ceil(self.size(part["height"]) / PATCH)
        return self.attachment("image", part, k, F.least(F.greatest(patches, F.lit(LEAST_PATCHES)), F.lit(MOST_PATCHES)) + 2)

    def audio(self, part: Column, k: Column) -> Column:
        return self.attachment("audio", part, k, F.ceil(self.size(part["seconds"]) * AUDIO_RATE))

    def document(self, part: Column, k: Column) -> Column:
        return self.attachment("document", part, k, self.size(part["pages"]) * PAGE_TOKENS)

    def visit(self, part: Column, kind: Column, k: Column) -> Column:
        """What the method of the part's type gives."""
        out = F.when(kind == "text", self.text(part, k))
        for name in self.kinds:
            out = out.when(kind == name, getattr(self, name)(part, k))
        return out


def flatten(messages: DataFrame, visitor: PartVisitor | None = None) -> DataFrame:
    """One row for each conversation; see the module."""
    visitor = visitor or PartVisitor()
    conv = Window.partitionBy("conv_id")
    first = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce("parts", F.array()).alias("parts"))
    first = first.withColumn("m", F.row_number().over(conv.orderBy("turn", "role", F.to_json("parts"))))
    part = first.select("conv_id", "m", safe_role(F.col("role")).alias("role"), F.posexplode_outer("parts").alias("p", "part"))
    kind = F.when(F.col("part.type").isin(*visitor.kinds), F.col("part.type")).otherwise("text")
    part = part.withColumn("kind", kind).withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "kind").orderBy("m", "p")) - 1)
    part = part.withColumn("p", F.coalesce("p", F.lit(0))).withColumn("seen", visitor.visit(F.col("part"), F.col("kind"), F.col("k")))
    part = part.withColumn("last", F.max("p").over(Window.partitionBy("conv_id", "m")))
    opened = F.when(F.col("p") == 0, F.concat(F.lit("<|"), "role", F.lit("|>\n"))).otherwise("")
    closed = F.when(F.col("p") == F.col("last"), F.lit("<|end|>\n")).otherwise("")
    part = part.select("conv_id", "m", "p", "kind", F.concat(opened, "seen.shown", closed).alias("shown"), "seen.line", F.col("seen.tokens").alias("tokens"))
    ordered = lambda c, mark: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("m", "p", F.col(c).alias("x")))), lambda s: s["x"]), mark)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("tokens"))), F.lit(0)).cast("bigint")
    is_text = F.col("kind") == "text"
    out = part.groupBy("conv_id").agg(ordered("shown", "").alias("prompt"), ordered("line", "\n").alias("attachments"), F.max("m").cast("bigint").alias("n_messages"), F.count_if(~is_text).alias("n_attachments"), total(is_text).alias("text_tokens"), total(~is_text).alias("attachment_tokens"))
    return out.withColumn("n_tokens", F.col("text_tokens") + F.col("attachment_tokens") + 2 * F.col("n_messages"))


def typed(conversations: DataFrame) -> DataFrame:
    """The conversations with typed parts: their text, and where 3 * conv_id + turn says so an attachment before or after it.

    The table has plain text alone, so attachments are made up here by rule: by the remainder modulo 4, with sizes from the ids.
    """
    n = 3 * F.col("conv_id") + F.col("turn")
    none = F.lit(None)
    blank = lambda **v: F.struct(*[v.get(name, none).cast(kind).alias(name) for name, kind in (("type", "string"), ("text", "string"), ("uri", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])
    text = blank(type=F.lit("text"), text=F.col("text"))
    uri = lambda k: F.format_string(f"{k}/%d/%d", "conv_id", "turn")
    image = blank(type=F.lit("image"), uri=uri("image"), width=200 + 37 * (n % 50), height=150 + 41 * (n % 30))
    pages = blank(type=F.lit("document"), uri=uri("document"), pages=1 + n % 9)
    audio = blank(type=F.lit("audio"), uri=uri("audio"), seconds=(n % 240) / 4)
    parts = F.when((n % 4 == 0) & (F.col("role") == "user"), F.array(image, text)).when((n % 4 == 1) & (F.col("role") == "user"), F.array(text, pages, image)).when((n % 4 == 2) & (F.col("role") == "assistant"), F.array(text, audio)).otherwise(F.array(text))
    return conversations.select("conv_id", "turn", "role", parts.alias("parts"))


def oracle() -> str:
    """typed and flatten in DuckDB SQL."""
    return rf"""
WITH c AS (SELECT *, 3 * conv_id + turn AS n FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS m FROM c),
k AS (SELECT conv_id, turn, n, m, role, text, CASE WHEN n % 4 = 0 AND role = 'user' THEN ['image', 'text'] WHEN n % 4 = 1 AND role = 'user' THEN ['text', 'document', 'image']
  WHEN n % 4 = 2 AND role = 'assistant' THEN ['text', 'audio'] ELSE ['text'] END AS kinds FROM r),
p AS (SELECT * EXCLUDE (kinds), len(kinds) AS total, unnest(kinds) AS kind, unnest(range(0, len(kinds))) AS p FROM k),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, kind ORDER BY m, p) - 1 AS i, CAST(CASE kind WHEN 'text' THEN ceil(octet_length(encode(coalesce(text, ''))) / {TEXT_BYTES}.0)
  WHEN 'image' THEN least(greatest(ceil((200 + 37 * (n % 50)) / {PATCH}.0) * ceil((150 + 41 * (n % 30)) / {PATCH}.0), {LEAST_PATCHES}), {MOST_PATCHES}) + 2
  WHEN 'document' THEN (1 + n % 9) * {PAGE_TOKENS} ELSE ceil((n % 240) / 4.0 * {AUDIO_RATE}) END AS BIGINT) AS tokens FROM p),
s AS (SELECT *, CASE WHEN p = 0 THEN '<|' || regexp_replace(coalesce(role, 'unknown'), '[^\p{{L}}\p{{N}}_.-]', '_', 'g') || '|>' || chr(10) ELSE '' END || CASE WHEN kind = 'text' THEN replace(CASE WHEN p > 0 AND starts_with(text, '|') THEN ' ' ELSE '' END || coalesce(text, ''), '<|', '< |') ELSE '<|' || kind || '_' || i || '|>' END
  || CASE WHEN p = total - 1 THEN '<|end|>' || chr(10) ELSE '' END AS shown, CASE WHEN kind <> 'text' THEN i || ' ' || kind || ' ' || kind || '/' || conv_id || '/' || turn || ' ' || tokens END AS line FROM t)
SELECT conv_id, string_agg(shown, '' ORDER BY m, p) AS prompt, coalesce(string_agg(line, chr(10) ORDER BY m, p), '') AS attachments, CAST(max(m) AS BIGINT) AS n_messages,
  CAST(count(line) AS BIGINT) AS n_attachments, CAST(coalesce(sum(tokens) FILTER (WHERE kind = 'text'), 0) AS BIGINT) AS text_tokens, CAST(coalesce(sum(tokens) FILTER (WHERE kind <> 'text'), 0) AS BIGINT) AS attachment_tokens,
  CAST(coalesce(sum(tokens), 0) + 2 * max(m) AS BIGINT) AS n_tokens FROM s GROUP BY conv_id
"""
