"""The text functions once more, as DuckDB expressions, to check the column functions against."""

from __future__ import annotations

from cueloom.functions.words import BREAK_AFTER, CLAUSE_WORDS, DANGLING_WORDS, FILLERS, HESITATIONS, REPLY_FILLERS, SHORTENINGS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


def squeeze(x: str) -> str:
    return f"trim({sub(x, r'\s+', ' ')})"


def strip(x: str, chars: str) -> str:
    return f"trim({x}, {q(chars)})"


def without_words(x: str, words: str, by: str) -> str:
    """RE2 has no look-around: neighbours are put back, and a second pass takes every other one of a row."""
    pattern = rf"(?i)(^|[^\pL\pN_])(?:{words})($|[^\pL\pN_])"
    return sub(sub(x, pattern, rf"\1{by}\2"), pattern, rf"\1{by}\2")


def normalize(x: str) -> str:
    x = without_words(strip(sub(x, r"\s+", " "), " ,"), HESITATIONS, "")
    return strip(sub(sub(sub(x, r"\s+,", ","), r",\s*,+", ","), r"\s+", " "), " ,")


def drop_fillers(x: str) -> str:
    return strip(sub(without_words(x, FILLERS, " "), r"\s+", " "), " ,")


def clean(x: str) -> str:
    for pattern in (r"<\d{2}:\d{2}:\d{2}[.,]\d{3}>", "</?c>", "<[^>]+>"):
        x = sub(x, pattern, "")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        x = f"replace({x}, {q(entity)}, {q(char)})"
    return squeeze(x)


def ends(x: str) -> str:
    return f"regexp_matches({x}, {q(r'[.!?…]["' + chr(39) + r'”’)\]]*\s*$')})"


def dangling(x: str) -> str:
    pattern = q(rf"(?i)(^|[^\pL\pN_])(?:{DANGLING_WORDS})\s*$")
    return f"(trim({x}) <> '' AND NOT {ends(x)} AND (regexp_matches(rtrim({squeeze(x)}, ' ,;:-'), {pattern}) OR regexp_matches({x}, {pattern})))"


def continuation(x: str) -> str:
    return f"regexp_matches({x}, {q(r'^\s*[\p{Ll}\p{Nd}]')})"


def n_words(x: str) -> str:
    return f"CASE WHEN {squeeze(x)}='' THEN 0 ELSE len(string_split({squeeze(x)}, ' ')) END"


def mid_cut(b: str, a: str) -> str:
    return f"""CASE WHEN {squeeze(b)}='' OR {squeeze(a)}='' THEN {squeeze(a)}<>'' WHEN {ends(b)} THEN false WHEN {dangling(b)} THEN true
      ELSE ({n_words(a)} <= 3 AND {ends(a)}) OR ({n_words(a)} <= 2 AND {continuation(a)}) END"""


def untranslated(zh: str, en: str) -> str:
    return f"(trim({zh}) <> '' AND {drop_fillers(en)} <> '' AND lower(trim({zh})) = lower({drop_fillers(en)}))"


def real(zh: str, en: str) -> str:
    return f"(trim(coalesce({zh},'')) <> '' AND NOT {untranslated(zh, en)})"


def clean_reply(x: str) -> str:
    x = strip(sub(f"replace({x}, ',', '，')", " {2,}", " "), "，, ")
    for filler in REPLY_FILLERS:
        x = f"replace({x}, {q(filler)}, '')"
    return x


def wrap(x: str) -> str:
    pattern = q(rf"(.{{1,32}}$|.{{15,31}}[{BREAK_AFTER}]|.{{32}})\s*")
    lines = f"list_filter(list_transform(regexp_extract_all({squeeze(x)}, {pattern}, 1), lambda z: trim(z)), lambda z: z <> '')"
    return f"CASE WHEN length({squeeze(x)}) <= 32 THEN {squeeze(x)} ELSE array_to_string({lines}, '\\N') END"


def millis(x: str) -> str:
    return f"CAST(round_even(({x})*1000, 0) AS BIGINT)"


def stamp(x: str, sep: str) -> str:
    ms = millis(f"greatest({x}, 0e0)")
    return f"concat(lpad(CAST({ms}//3600000 AS VARCHAR),2,'0'),':',lpad(CAST({ms}//60000%60 AS VARCHAR),2,'0'),':',lpad(CAST({ms}//1000%60 AS VARCHAR),2,'0'),'{sep}',lpad(CAST({ms}%1000 AS VARCHAR),3,'0'))"


def ass_stamp(x: str) -> str:
    cs = f"CAST(round_even(greatest({x}, 0e0)*100, 0) AS BIGINT)"
    return f"concat(CAST({cs}//360000 AS VARCHAR),':',lpad(CAST({cs}//6000%60 AS VARCHAR),2,'0'),':',lpad(CAST({cs}//100%60 AS VARCHAR),2,'0'),'.',lpad(CAST({cs}%100 AS VARCHAR),2,'0'))"


def rate(dur: str, slot: str) -> str:
    return f"CASE WHEN {dur}<=0 OR {slot}<=0 OR {dur}/{slot}-1e0<=0 THEN 0 ELSE greatest(1, least(30, CAST(ceil(({dur}/{slot}-1e0)*100*105e-2) AS INT))) END"


def shorten_steps(x: str) -> tuple[str, list[str]]:
    """CTEs h0..h12 over a table base(key columns, t), each with the text after one more deletion."""
    steps = []
    for i, (old, new) in enumerate(SHORTENINGS, 1):
        changed = f"replace(t{i - 1}, {q(old)}, {q(new)})"
        tidy = strip(sub(changed, r"[，。\s]{2,}", "，"), "，。 ")
        steps.append(f"h{i} AS (SELECT *, CASE WHEN {changed} <> t{i - 1} THEN {tidy} ELSE t{i - 1} END AS t{i} FROM h{i - 1})")
    return strip(sub(x, r"[，。！？、\s]+", "，"), "，"), steps


def _folded(name: str, src: str, keys: str, order: str, piece: str, step: str) -> str:
    """The CTE ``name`` (keys, n, c): the pieces that a fold over each group of src leaves, numbered from 0.

    piece is the struct that stands for a row; step gives the pieces so far, acc, once the list x of the next one is taken in.
    """
    return f"""{name}_in AS (SELECT {keys}, list([{piece}] ORDER BY {order}) AS a FROM {src} GROUP BY ALL),
{name}_out AS (SELECT {keys}, list_reduce(a, lambda acc, x: {step}) AS o FROM {name}_in),
{name} AS (SELECT {keys}, unnest(generate_series(0, len(o)-1)) AS n, unnest(o) AS c FROM {name}_out)"""


def collapsed(src: str) -> str:
    """Rolling captions of src collapsed: (video_id, n, c.s, c.e, c.t)."""
    old, new = "acc[-1]", "x[1]"
    longer = lambda f: f"CASE WHEN length({new}.t) >= length({old}.t) THEN {new}.{f} ELSE {old}.{f} END"
    joined = f"{{'s': {old}.s, 'e': greatest({old}.e, {new}.e), 't': {longer('t')}, 'k': {longer('k')}}}"
    closed = f"{{'s': {old}.s, 'e': greatest({old}.e, {new}.s), 't': {old}.t, 'k': {old}.k}}"
    step = f"CASE WHEN starts_with({new}.k, {old}.k) OR starts_with({old}.k, {new}.k) THEN list_concat(acc[:-2], [{joined}]) ELSE list_concat(acc[:-2], [{closed}], x) END"
    return _folded("collapsed", src, "video_id", "cue_no", f"{{'s': start_s, 'e': end_s, 't': text, 'k': lower({squeeze('text')})}}", step)


def deltas(src: str) -> str:
    """What is new in each cue of src: (video_id, n, c.s, c.e, c.t)."""
    grown = "acc[-1].f <> '' AND starts_with(x[1].f, acc[-1].f)"
    new = "trim(substr(x[1].f, length(acc[-1].f) + 1), ' ,.-')"
    step = f"CASE WHEN {grown} AND {new} = '' THEN acc ELSE list_concat(acc, [{{'s': x[1].s, 'e': x[1].e, 't': CASE WHEN {grown} THEN {new} ELSE x[1].f END, 'f': x[1].f}}]) END"
    return _folded("deltas", src, "video_id", "cue_no", f"{{'s': start_s, 'e': end_s, 't': {squeeze('text')}, 'f': {squeeze('text')}}}", step)


def joined_pieces(name: str, src: str, keys: str, order: str, may_join: str, times: float, max_len: float = 8.5, max_chars: int = 140) -> str:
    """Pieces (start_s, end_s, text) of src joined to the one before, a, where the cut is in mid sentence, or may_join holds and both stay within times the limits."""
    a, b = "acc[-1]", "x[1]"
    both = normalize(f"concat({a}.t, ' ', {b}.t)")
    within = f"{b}.e - {a}.s <= {max_len * times!r}e0 AND length({both}) <= {int(max_chars * times)}"
    joins = f"{b}.s - {a}.e <= 75e-2 AND ({mid_cut(f'{a}.t', f'{b}.t')} OR ({may_join.format(a=a, b=b)}) AND {within})"
    step = f"CASE WHEN {joins} THEN list_concat(acc[:-2], [{{'s': {a}.s, 'e': {b}.e, 't': {both}}}]) ELSE list_concat(acc, x) END"
    return _folded(name, src, keys, order, "{'s': start_s, 'e': end_s, 't': text}", step)


def tiny(p: str, min_dur: float = 1.4, min_words: int = 4) -> str:
    return f"({p}.e - {p}.s < {min_dur!r}e0 OR {n_words(f'{p}.t')} < {min_words})"


def wrapped(src: str, max_chars: int = 140) -> str:
    """CTEs up to lines(k, part, line_no, piece): what force_wrap makes of src(k, part, t), whose words are parted by single spaces."""
    core = "rtrim(word, ' ,;:-')"
    opens = f"regexp_matches({core}, {q(rf'(?i)(^|[^\pL\pN_])(?:{DANGLING_WORDS})$')})"
    dangles = "(solid[j] >= first AND open[j])"
    may_end = f"lambda j: marked[j] OR (ends[j] - start >= {max_chars * 0.55!r}::DOUBLE AND NOT {dangles})"
    stops = f"lambda j: j = n OR NOT {dangles} OR (j > first AND ends[j+1] - start > {int(max_chars * 1.25)})"
    return f"""too_long AS MATERIALIZED (SELECT k, part, string_split(t, ' ') AS words FROM {src} WHERE length(t) > {max_chars}),
spread AS (SELECT k, part, unnest(words) AS word, unnest(generate_series(1, len(words))) AS j FROM too_long),
told AS (SELECT *, {core} <> '' AS is_solid, {opens} AS opens, {ends('word')} AS closed FROM spread),
summed AS (SELECT k, part, j, word, sum(length(word) + 1) OVER o - 1 AS finish, right(word, 1) IN (',', ';', ':') AS marks, coalesce(max(CASE WHEN is_solid THEN j END) OVER o, 0) AS last_solid,
  coalesce(last_value(CASE WHEN is_solid THEN opens END IGNORE NULLS) OVER o, false) AND NOT closed AS is_open FROM told WINDOW o AS (PARTITION BY k, part ORDER BY j ROWS UNBOUNDED PRECEDING)),
known AS MATERIALIZED (SELECT k, part, count(*) AS n, list(word ORDER BY j) AS words, list(finish::BIGINT ORDER BY j) AS ends, list(marks ORDER BY j) AS marked, list(last_solid::BIGINT ORDER BY j) AS solid, list(is_open ORDER BY j) AS open FROM summed GROUP BY 1, 2),
walk(k, part, line_no, first, last) AS (SELECT k, part, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM known
  UNION ALL SELECT k, part, line_no, first, list_filter(range(held, least(n, held + {max_chars + 2}) + 1), {stops})[1] AS last
  FROM (SELECT *, coalesce(list_filter(range(first + 1, greatest(first, len(list_filter(ends, lambda x: x <= start + {max_chars}))) + 1), {may_end})[-1], first) AS held
    FROM (SELECT w.k, w.part, w.line_no + 1 AS line_no, w.last + 1 AS first, known.ends[w.last + 1] - length(known.words[w.last + 1]) AS start, n, ends, marked, solid, open FROM walk w JOIN known ON known.k = w.k AND known.part = w.part WHERE w.last < n))),
lines AS (SELECT k, part, line_no, array_to_string(words[first:last], ' ') AS piece FROM walk JOIN known USING (k, part) WHERE first > 0 UNION ALL SELECT k, part, 1, t FROM {src} WHERE length(t) <= {max_chars} AND t <> '')"""


def softened(src: str, max_chars: int = 140) -> str:
    """CTEs up to lines(k, part, line_no, piece): what soft_split makes of src(k, text)."""
    clause = q(rf"(?i)^(?:{CLAUSE_WORDS})($|[^\pL\pN_])")
    spacing, joined = max(24, max_chars // 5), normalize("concat(r.held, ' ', c.piece)")
    return f"""bare AS MATERIALIZED (SELECT k, t, string_split(t, ' ') AS words FROM (SELECT k, {normalize('text')} AS t FROM {src})),
gaps AS (SELECT k, unnest(words) AS word, unnest(generate_series(1, len(words))) AS j, words FROM bare WHERE length(t) > {max_chars}),
openings AS (SELECT k, j, sum(length(word) + 1) OVER (PARTITION BY k ORDER BY j ROWS UNBOUNDED PRECEDING) - 1 AS place, right(word, 1) IN (',', ';') OR regexp_matches(concat_ws(' ', words[j+1], words[j+2], words[j+3]), {clause}) AS opens, j < len(words) AS inside FROM gaps),
places AS MATERIALIZED (SELECT k, list(place::BIGINT ORDER BY j) AS places FROM openings WHERE opens AND inside GROUP BY 1),
cuts(k, cut) AS (SELECT k, 0::BIGINT FROM bare WHERE length(t) > {max_chars} UNION ALL SELECT * FROM (SELECT c.k, list_filter(places, lambda p: p >= c.cut + {spacing})[1] AS cut FROM cuts c JOIN places ON places.k = c.k) WHERE cut IS NOT NULL),
between AS (SELECT b.k, cut, {strip("substr(t, cut + 1, coalesce(lead(cut) OVER (PARTITION BY b.k ORDER BY cut), length(t)) - cut)", ' ,;')} AS piece FROM cuts JOIN bare b ON b.k = cuts.k),
clauses AS MATERIALIZED (SELECT k, piece, row_number() OVER (PARTITION BY k ORDER BY cut) AS n, count(*) OVER (PARTITION BY k) AS of_all FROM between WHERE piece <> ''),
rejoin(k, n, part, held) AS (SELECT k, 1::BIGINT, 0::BIGINT, piece FROM clauses WHERE n = 1 AND of_all > 1
  UNION ALL SELECT k, n, CASE WHEN fresh THEN part + 1 ELSE part END, CASE WHEN fresh THEN piece ELSE joined END
  FROM (SELECT *, length(held) >= {max_chars * 0.6!r}::DOUBLE OR length(joined) > {int(max_chars * 1.1)} AS fresh FROM (SELECT r.k, c.n, r.part, r.held, c.piece, {joined} AS joined FROM rejoin r JOIN clauses c ON c.k = r.k AND c.n = r.n + 1))),
soft AS (SELECT k, part, arg_max(held, n) AS t FROM rejoin GROUP BY 1, 2 UNION ALL SELECT k, 0, t FROM bare b WHERE NOT EXISTS (SELECT 1 FROM clauses c WHERE c.k = b.k AND of_all > 1)),
{wrapped('soft', max_chars)}"""
