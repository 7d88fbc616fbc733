"""Cleaning, segmentation and admission of texts (first rule set), as expressions only."""

from __future__ import annotations

from inkwell.plans.dialect import Dialect

#: Abbreviations whose periods don't end a sentence, the split's next characters, closing marks.
ABBREVIATIONS = ("e.g.", "i.e.", "et al.", "Fig.", "Figs.", "Dr.", "Prof.", "vs.", "No.", "Eq.", "Eqs.", "Ref.", "Refs.", "U.S.", "U.K.")
NEXT = r"[A-Z0-9\x22\x{201C}\x27(\[]"
CLOSED = r"[.!?][\x22\x{201D}\x{2019})]*$"
NONPROSE_PREFIXES = ("specifications table", "methods details", "subject area:", "more specific subject area:", "method name:", "name and reference of original method:", "resource availability:", "article information", "graphical abstract")
SPACE = r"[ \t\r\n\f\x0B\x{00A0}]+"
PERIOD, CUT = "", ""
#: Sentences of the input, words of the input and of each sentence at least, and the least share of Latin letters.
INPUT, LEAST_WORDS, LEAST_SENTENCE_WORDS, LATIN = 5, 35, 5, 0.9
#: Characters at a text's beginning that are searched for its first sentences before the whole text is.
HEAD = 1000


def clean(d: Dialect, x: str) -> str:
    if type(d) is not Dialect:  # the same, passing over single spaces: a blank that is none, or has another after it, begins a run to replace
        return d.replace(f"trim({d.replace(x, f'{SPACE[:-1]}(?:(?<! )|{SPACE[:-1]}){SPACE[:-1]}*', ' ')})", " +([,.;:!?])", "\\1")
    return d.replace(f"trim({d.replace(x, SPACE, ' ')})", " +([,.;:!?])", "\\1")


def protect(d: Dialect, x: str) -> str:
    """Periods of abbreviations, in any case, become a mark: one pass for all with one period, and one for each pair of letters."""
    single = [a[:-1] for a in ABBREVIATIONS if a.count(".") == 1]
    pairs = [a.split(".")[:2] for a in ABBREVIATIONS if a.count(".") == 2]
    plain = x
    for first, second in pairs:
        x = d.replace(x, f"(?i)({first})[.]({second})[.]", f"\\1{PERIOD}\\2{PERIOD}")
    if type(d) is not Dialect:  # the same, looking back from periods; the passes for pairs of letters only where there is one
        some = "|".join(f"{first}[.]{second}" for first, second in pairs)
        x = f"CASE WHEN {d.like(plain, f'(?i)[.][{''.join(second for _, second in pairs)}][.](?<=(?:{some})[.])')} THEN {x} ELSE {plain} END"
        return d.replace(x, f"(?i)[.](?<=(?:{'|'.join(single)})[.])", PERIOD)
    return d.replace(x, f"(?i)({'|'.join(single)})[.]", f"\\1{PERIOD}")


def marked(d: Dialect) -> str:
    """The guarded body with a mark at each boundary."""
    return d.replace("guarded", rf"([.!?]) +({NEXT})", f"\\1{CUT}\\2")


def chunked(d: Dialect, protected: bool = True) -> str:
    """CTEs up to chunks(doc_id, source, lang, body, pos, sentence, complete): a row for each chunk between boundaries."""
    guarded = protect(d, "body") if protected else "body"
    return f"""bodies AS (SELECT doc_id, source, lang, {clean(d, 'text')} AS body FROM {d.table('documents')} WHERE text IS NOT NULL),
    guards AS (SELECT doc_id, source, lang, body, {guarded} AS guarded FROM bodies),
    marks AS (SELECT doc_id, source, lang, body, {d.split(marked(d), CUT)} AS parts FROM guards),
    exploded AS ({d.unnest('doc_id, source, lang, body', 'parts', 'marks')}),
    chunks AS (SELECT doc_id, source, lang, body, pos, sentence, {d.like('sentence', CLOSED)} AS complete
               FROM (SELECT doc_id, source, lang, body, pos, trim(replace(val, '{PERIOD}', '.')) AS sentence FROM exploded) c)"""


def pieces(d: Dialect, body: str, protected: bool = True) -> str:
    """The chunks of a body, as an array; the body's expression is evaluated once."""
    guarded = protect(d, "b") if protected else "b"
    return f"get(transform(array({body}), b -> transform({d.split(marked(d).replace('guarded', guarded, 1), CUT)}, x -> trim(replace(x, '{PERIOD}', '.')))), 0)"


def completed(d: Dialect, parts: str) -> str:
    return f"filter({parts}, x -> {d.like('x', CLOSED)})"


def kept_arrays(d: Dialect, protected: bool = True, whole: bool = False, first: int | None = None, source: str = "") -> str:
    """CTEs up to kept(doc_id, source, lang, kept): each document's complete sentences as an array, which needs no window. Whole: up to parted(doc_id, body, parts), with all chunks.

    First: so many sentences at least where a document has them, from its HEAD characters if they do. Each rule looks at
    a few characters only, so that a text's beginning is cut where the text is, but for its last chunk, which the end
    of the beginning may have cut. Source: what takes the place of the table.
    """
    source = source or d.table("documents")
    if first is not None:
        cut = f"length(text) > {HEAD}"
        sure = completed(d, f"CASE WHEN {cut} THEN slice(parts, 1, size(parts) - 1) ELSE parts END")
        every = completed(d, pieces(d, clean(d, "text"), protected))
        return f"""headed AS ({d.once('doc_id, source, lang, text', pieces(d, clean(d, f"substr(text, 1, {HEAD})"), protected), 'parts', source)} WHERE text IS NOT NULL),
    heads AS ({d.once('doc_id, source, lang, text', sure, 'head', 'headed')}),
    kept AS ({d.once('doc_id, source, lang', f"CASE WHEN {cut} AND size(head) < {first} THEN {every} ELSE head END", 'kept', 'heads')})"""
    ctes = f"bodies AS ({d.once('doc_id, source, lang', clean(d, 'text'), 'body', source)} WHERE text IS NOT NULL)"
    if whole:
        return f"{ctes}, parted AS ({d.once('doc_id, body', pieces(d, 'body', protected), 'parts', 'bodies')})"
    return f"{ctes}, kept AS ({d.once('doc_id, source, lang', completed(d, pieces(d, 'body', protected)), 'kept', 'bodies')})"


def sentences(d: Dialect, protected: bool = True, first: int | None = None) -> str:
    """CTEs up to sents(doc_id, source, lang, n, sentence): complete sentences, numbered from 1. First: those up to this number are enough, there may be more."""
    if d.by_row("documents", "doc_id"):
        taken = "kept" if first is None else f"slice(kept, 1, {first})"
        return kept_arrays(d, protected, first=first) + f""",
    placed_sents AS ({d.unnest('doc_id, source, lang', taken, 'kept')}),
    sents AS (SELECT doc_id, source, lang, pos + 1 AS n, val AS sentence FROM placed_sents)"""
    return chunked(d, protected) + """,
    sents AS (SELECT doc_id, source, lang, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS n, sentence FROM chunks WHERE complete)"""


def sixes(d: Dialect) -> str:
    """CTEs up to six(doc_id, source, lang, n_sentences, input_text, sixth, words, latin, fewest)."""
    latin = "CAST(length(regexp_replace(input_text, '[^A-Za-z]', '')) AS DOUBLE)" if type(d) is not Dialect else "CAST(length(regexp_replace(input_text, '[^A-Za-z]', '', 'g')) AS DOUBLE)"
    letters = f"length({d.replace('input_text', '[^\\p{L}]', '')})"
    if d.by_row("documents", "doc_id"):
        rolled = f"""named_struct('n', CAST(least(size(kept), {INPUT + 1}) AS BIGINT), 'input', array_join(slice(kept, 1, {INPUT}), ' '), 'sixth', get(kept, {INPUT}), 'fewest', array_min(transform(slice(kept, 1, {INPUT}), x -> {d.words('x')})))"""
        counts = f"named_struct('words', {d.words('input_text')}, 'latin', {latin} / greatest({letters}, 1))"
        return kept_arrays(d, first=INPUT + 1) + f""",
    taken AS ({d.once('doc_id, source, lang', rolled, 'rolled', 'kept')} WHERE size(kept) > 0),
    rolled AS (SELECT doc_id, source, lang, rolled.n AS n_sentences, rolled.input AS input_text, rolled.sixth AS sixth, rolled.fewest AS fewest FROM taken),
    counted_six AS ({d.once('doc_id, source, lang, n_sentences, input_text, sixth, fewest', counts, 'counts', 'rolled')}),
    six AS (SELECT doc_id, source, lang, n_sentences, input_text, sixth, fewest, counts.words AS words, counts.latin AS latin FROM counted_six)"""
    return sentences(d) + f""",
    sized AS (SELECT doc_id, source, lang, n, sentence, {d.words('sentence')} AS words FROM sents WHERE n <= {INPUT + 1}),
    rolled AS (SELECT doc_id, min(source) AS source, min(lang) AS lang, CAST(count(*) AS BIGINT) AS n_sentences,
                      {d.gather(f'CASE WHEN n <= {INPUT} THEN sentence END', 'n', ' ')} AS input_text,
                      max(CASE WHEN n = {INPUT + 1} THEN sentence END) AS sixth, min(CASE WHEN n <= {INPUT} THEN words END) AS fewest
               FROM sized GROUP BY doc_id),
    six AS (SELECT doc_id, source, lang, n_sentences, input_text, sixth, fewest, {d.words('input_text')} AS words, {latin} / greatest({letters}, 1) AS latin FROM rolled)"""


ADMITTED = f"(n_sentences > {INPUT} AND latin >= {LATIN} AND words >= {LEAST_WORDS} AND fewest >= {LEAST_SENTENCE_WORDS})"


def sentence_split(d: Dialect) -> str:
    return f"WITH {sentences(d)} SELECT doc_id, n AS sentence_no, sentence FROM sents"


def first_six_sentences(d: Dialect) -> str:
    return f"WITH {sixes(d)} SELECT doc_id, input_text, CAST(length(input_text) AS BIGINT) AS input_characters, substr(sixth, 1, 250) AS sixth FROM six WHERE n_sentences > {INPUT} AND lang = 'en'"


def english_admission(d: Dialect) -> str:
    return f"WITH {sixes(d)} SELECT doc_id, n_sentences, words, fewest, round(latin, 6) AS latin, {ADMITTED} AS admitted FROM six"


def word_counts(d: Dialect) -> str:
    return f"SELECT doc_id, {d.words('text')} AS words, {d.matches('text', '[0-9]+')} AS numbers FROM {d.table('documents')}"


def clean_text(d: Dialect) -> str:
    cited = d.replace("text", r"\([^()]*[0-9][^()]*\)", " ")
    return f"SELECT doc_id, {d.matches('text', r'[(][^()]*[0-9][^()]*[)]')} AS parentheticals_removed, {d.sha(clean(d, cited))} AS clean_sha256 FROM {d.table('documents')}"


def nonprose_prefix(d: Dialect) -> str:
    """Sentences that open like metadata are left out before the first prose sentence, and flagged after it. Cleaning keeps words as they are, so only texts with all words of a prefix are split."""
    test = " OR ".join(f"lower(sentence) LIKE '{p}%'" for p in NONPROSE_PREFIXES)
    if d.by_row("documents", "doc_id"):
        found = " OR ".join("(" + " AND ".join(f"contains(low, '{w.strip(':')}')" for w in p.split(" ")) + ")" for p in NONPROSE_PREFIXES)
        likely = f"""(SELECT doc_id, source, lang, text FROM ({d.once('doc_id, source, lang, text', 'lower(text)', 'low', d.table('documents'))}) l WHERE {found}) likely"""
        return f"""WITH {kept_arrays(d, source=likely)}, tested AS ({d.once('doc_id', f'transform(kept, sentence -> ({test}))', 'tests', 'kept')}),
    spread AS ({d.unnest("doc_id, array_position(tests, FALSE) AS first_prose", "tests", "tested")})
    SELECT doc_id, pos + 1 AS sentence_no, CASE WHEN first_prose > 0 AND pos + 1 > first_prose THEN 'metadata_after_narrative_start' ELSE 'omitted_before_narrative' END AS flag FROM spread WHERE val"""
    return f"""WITH {sentences(d)}, marked AS (SELECT doc_id, n, ({test}) AS nonprose FROM sents),
    begun AS (SELECT doc_id, n, nonprose, max(CASE WHEN NOT nonprose THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS started FROM marked)
    SELECT doc_id, n AS sentence_no, CASE WHEN coalesce(started, 0) = 1 THEN 'metadata_after_narrative_start' ELSE 'omitted_before_narrative' END AS flag FROM begun WHERE nonprose"""


def sentence_offsets(d: Dialect) -> str:
    """Start and end (zero-based, end exclusive) of each complete sentence in its cleaned text.

    Within a row, chunks lie in blocks, as many as the root of their number; one begins after the sums of whole blocks
    and of the chunks before it in its own. Only bodies that differ from their chunks' join are searched for each.
    """
    if d.by_row("documents", "doc_id"):
        add = "CAST(0 AS BIGINT), (a, y) -> a + y"
        sizes = "transform(slice(parts, b * block + 1, block), x -> CAST(length(x) + 1 AS BIGINT))"
        blocks = f"transform(sequence(0, CAST((size(parts) - 1) div block AS INT)), b -> {sizes})"
        begins = f"flatten(transform(blocks, (s, b) -> transform(s, (z, j) -> aggregate(slice(sums, 1, b), {add}) + aggregate(slice(s, 1, j), {add}))))"
        chunks = f"transform(zip_with(parts, begins, (x, begun) -> named_struct('sentence', x, 'begun', begun)), (x, i) -> named_struct('pos', i, 'begun', x.begun, 'sentence', x.sentence))"
        exact = "aligned OR substr(body, CAST(x.begun AS INT) + 1, length(x.sentence)) = x.sentence"
        found = f"transform(filter({chunks}, x -> {d.like('x.sentence', CLOSED)}), x -> named_struct('pos', x.pos, 'begun', x.begun, 'len', length(x.sentence), 'exact', {exact}))"
        return f"""WITH {kept_arrays(d, whole=True)},
    measured AS (SELECT doc_id, body, parts, CAST(ceil(sqrt(size(parts))) AS INT) AS block FROM parted),
    blocked AS ({d.once('doc_id, body, parts', blocks, 'blocks', 'measured')}),
    summed AS ({d.once('doc_id, body, parts, blocks', f"transform(blocks, s -> aggregate(s, {add}))", 'sums', 'blocked')}),
    begun AS ({d.once('doc_id, body, parts', begins, 'begins', 'summed')}),
    aligned AS ({d.once('doc_id, body, parts, begins', "body = array_join(parts, ' ')", 'aligned', 'begun')}),
    found AS ({d.once('doc_id', found, 'found', 'aligned')})
    SELECT doc_id, CAST(p AS BIGINT) AS pos, begun AS start_char, begun + len AS end_char, exact FROM found LATERAL VIEW OUTER inline(found) x AS p, begun, len, exact WHERE p IS NOT NULL"""
    return f"""WITH {chunked(d)}, placed AS (SELECT doc_id, pos, sentence, complete, body,
        coalesce(sum(length(sentence) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM chunks)
    SELECT doc_id, pos, CAST(begun AS BIGINT) AS start_char, CAST(begun + length(sentence) AS BIGINT) AS end_char, substr(body, CAST(begun AS INT) + 1, length(sentence)) = sentence AS exact FROM placed WHERE complete"""


def boundary_context(d: Dialect) -> str:
    """Up to 200 characters of complete sentences before and after the sixth."""
    if d.by_row("documents", "doc_id"):  # a sentence has a character and a space at least, so that 100 of them fill 200
        return f"""WITH {kept_arrays(d)} SELECT doc_id, {d.tail("array_join(slice(kept, 1, 5), ' ')", 200)} AS before_sixth, substr(array_join(slice(kept, 7, 100), ' '), 1, 200) AS after_sixth FROM kept WHERE size(kept) >= 6"""
    taken = "sum(CASE WHEN n > 6 THEN length(sentence) + 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""WITH {sentences(d)}, placed AS (SELECT doc_id, n, sentence, coalesce({taken}, 0) AS taken FROM sents),
    joined AS (SELECT doc_id, {d.gather('CASE WHEN n < 6 THEN sentence END', 'n', ' ')} AS before_text, {d.gather('CASE WHEN n > 6 THEN sentence END', 'n', ' ')} AS after_text, max(n) AS top FROM placed WHERE taken < 200 GROUP BY doc_id)
    SELECT doc_id, {d.tail('before_text', 200)} AS before_sixth, coalesce(substr(after_text, 1, 200), '') AS after_sixth FROM joined WHERE top >= 6"""


def short_included(d: Dialect) -> str:
    """Documents of which one of the first six sentences has fewer than 20 characters."""
    if d.by_row("documents", "doc_id"):
        return f"""WITH {kept_arrays(d, first=6)}, shorts AS (SELECT doc_id, CAST(size(filter(slice(kept, 1, 6), x -> length(x) < 20)) AS BIGINT) AS short_sentences FROM kept WHERE size(kept) > 0)
    SELECT doc_id, short_sentences, short_sentences > 0 AS rejected FROM shorts"""
    return f"WITH {sentences(d)} SELECT doc_id, CAST(sum(CASE WHEN length(sentence) < 20 THEN 1 ELSE 0 END) AS BIGINT) AS short_sentences, min(length(sentence)) < 20 AS rejected FROM sents WHERE n <= 6 GROUP BY doc_id"


def match_excerpts(d: Dialect) -> str:
    """The first decimal or reference number that runs into a capital, with up to 55 characters to either side."""
    hit = d.extract("text", "[0-9][.][A-Z]", 0)
    return f"""WITH found AS (SELECT doc_id, text, {hit} AS hit FROM {d.table('documents')} WHERE text IS NOT NULL), placed AS (SELECT doc_id, text, hit, CAST(position(hit IN text) AS INT) AS spot FROM found WHERE hit <> '')
    SELECT doc_id, CAST(spot - 1 AS BIGINT) AS start_char, substr(text, greatest(1, spot - 55), spot - greatest(1, spot - 55) + length(hit) + 55) AS excerpt FROM placed"""


def old_new_change_flags(d: Dialect) -> str:
    """Whether protecting abbreviations changes the input or the sixth sentence; null with too few sentences."""
    if d.by_row("documents", "doc_id"):
        differ = lambda part: f"CASE WHEN size(kept) > 5 AND size(old_kept) > 5 THEN {part('kept')} <> {part('old_kept')} END"
        return f"""WITH bodies AS ({d.once('doc_id', clean(d, 'text'), 'body', d.table('documents'))}),
    kept AS ({d.once('doc_id, body', completed(d, pieces(d, 'body')), 'kept', 'bodies')}),
    both_kept AS ({d.once('doc_id, kept', completed(d, pieces(d, 'body', False)), 'old_kept', 'kept')})
    SELECT doc_id, {differ(lambda k: f"array_join(slice({k}, 1, 5), ' ')")} AS input_changed, {differ(lambda k: f"get({k}, 5)")} AS target_changed FROM both_kept"""
    plain = sentences(d, protected=False)
    for name in ("bodies", "guards", "marks", "exploded", "chunks", "sents"):
        plain = plain.replace(f"{name} AS", f"old_{name} AS").replace(f"FROM {name}", f"FROM old_{name}")
    return f"""WITH {sentences(d)}, {plain},
    new AS (SELECT doc_id, {d.gather('CASE WHEN n <= 5 THEN sentence END', 'n', ' ')} AS input_text, max(CASE WHEN n = 6 THEN sentence END) AS sixth FROM sents WHERE n <= 6 GROUP BY doc_id),
    old AS (SELECT doc_id, {d.gather('CASE WHEN n <= 5 THEN sentence END', 'n', ' ')} AS input_text, max(CASE WHEN n = 6 THEN sentence END) AS sixth FROM old_sents WHERE n <= 6 GROUP BY doc_id)
    SELECT b.doc_id, CASE WHEN new.sixth IS NULL OR old.sixth IS NULL THEN NULL ELSE new.input_text <> old.input_text END AS input_changed,
           CASE WHEN new.sixth IS NULL OR old.sixth IS NULL THEN NULL ELSE new.sixth <> old.sixth END AS target_changed
    FROM {d.table('documents')} b LEFT JOIN new ON b.doc_id = new.doc_id LEFT JOIN old ON b.doc_id = old.doc_id"""


def leakage_check(d: Dialect) -> str:
    return f"WITH {sixes(d)} SELECT doc_id, position(sixth IN input_text) > 0 AS leaked FROM six WHERE sixth IS NOT NULL"


def pretokenize(d: Dialect) -> str:
    """Pre-tokens with their leading space; joined again they give the text between its outer spaces."""
    return f"SELECT doc_id, CAST({'size' if type(d) is not Dialect else 'len'}({d.all_matches('text', ' ?[^ ]+| +')}) AS BIGINT) AS pre_tokens, {d.sha(d.array_text(d.all_matches('text', ' ?[^ ]+| +'), '|'))} AS pre_sha256 FROM {d.table('documents')} WHERE text IS NOT NULL"


def chat_render(d: Dialect) -> str:
    turn = "'<|im_start|>' || role || '\n' || text || '<|im_end|>'"
    if type(d) is not Dialect:
        turn = "concat('<|im_start|>', role, '\\n', text, '<|im_end|>')"
    mark = "\n" if type(d) is Dialect else "\\n"
    return f"SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, {d.sha(d.gather(turn, 'turn', mark))} AS chat_sha256 FROM {d.table('conversations')} GROUP BY conv_id"


QUERIES = (sentence_split, first_six_sentences, english_admission, word_counts, clean_text, nonprose_prefix, sentence_offsets, boundary_context, short_included, match_excerpts, old_new_change_flags, leakage_check, pretokenize, chat_render)
