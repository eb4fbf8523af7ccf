"""SQL for DuckDB that states the collapse of blocks; of the compatibility forms only full-width ones and blanks, which the tables hold."""

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_THIN = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
_BLANKS = "\u00a0\u2002\u2003\u2007\u2009\u202f\u3000"
_UNSEEN = "[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\ufe00-\ufe0f]"
_DASH = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe63\uff0d-"
_M, _P = "\ue000", "\ue001"  # stand for a sign and a decimal point


def _plain(x: str) -> str:
    wide = f"translate(translate(nfc_normalize({x}), '{_WIDE}', '{_THIN}'), '{_BLANKS}', '{' ' * len(_BLANKS)}')"
    return f"replace(lower(regexp_replace({wide}, '{_UNSEEN}', '', 'g')), 'ß', 'ss')"


def _flat(x: str) -> str:
    """The neighbours that a pattern may only look at are matched and put back; what they hide is met by a second pass."""
    sub = lambda t, p, r: f"regexp_replace({t}, '{p}', '{r}', 'g')"
    t = sub(x, rf"(^|[^\w.,])[{_DASH}](\.?\d)", rf"\1{_M}\2")
    for _ in range(2):
        t = sub(t, r"(^|[^\d.,])(\d{1,3})[,''\u2019](\d{3})[,''\u2019](\d{3})($|[^\d])".replace("\\u2019", "\u2019"), r"\1\2\3\4\5")
        t = sub(t, r"(^|[^\d.,])(\d{1,3})[,''\u2019](\d{3})($|[^\d])".replace("\\u2019", "\u2019"), r"\1\2\3\4")
    for _ in range(2):
        t = sub(t, r"(\d)[.,](\d)", rf"\1{_P}\2")
    t = sub(t, rf"(^|[\s{_M}])\.(\d)", rf"\1{_P}\2")
    t = sub(t, rf"[^\p{{L}}\p{{N}}\p{{M}}{_M}{_P}]+", "")
    return f"replace(replace({t}, '{_M}', '-'), '{_P}', '.')"


_LABELS = r"(^|[^\w])(claim|unit|source|period|asked\s+by)\s*[:=]"
_CLASSES = f"""raw AS MATERIALIZED (SELECT question AS text, count(DISTINCT id) AS n, min(id) AS first FROM blocks WHERE id IS NOT NULL AND question IS NOT NULL GROUP BY 1),
pl AS MATERIALIZED (SELECT *, {_plain('text')} AS p FROM raw), fl AS MATERIALIZED (SELECT *, {_flat('p')} AS content, string_split(regexp_replace(p, '{_LABELS}', '\\1' || chr(2) || '\\2' || chr(3),
  'g'), chr(2)) AS parts FROM pl),
fd AS (SELECT text, n, first, content, CASE WHEN len(parts) >= 3 THEN array_to_string(list_sort(list_filter(list_concat([{_flat('parts[1]')}], list_transform(parts[2:],
  lambda x: {_flat('string_split(x, chr(3))[1]')} || chr(30) || {_flat('string_split(x, chr(3))[2]')})), lambda x: x <> '')), chr(31)) END AS f FROM fl WHERE content <> ''),
ky AS (SELECT content, coalesce('f:' || max(f), 't:' || content) AS k FROM fd GROUP BY content),
cl AS MATERIALIZED (SELECT text, n, first, k FROM fd JOIN ky USING (content))"""

COLLAPSED = "WITH " + _CLASSES + " SELECT min(first) AS first_id, arg_min(text, {'i': first, 't': text}) AS question, sum(n)::BIGINT AS n_ids, count(*) AS n_raw FROM cl GROUP BY k"
FOUND = "WITH " + _CLASSES + """, c AS (SELECT k, min(first) AS first_id, sum(n) AS ids FROM cl GROUP BY 1)
SELECT DISTINCT c.first_id, b.id AS copy_id FROM blocks b JOIN cl ON cl.text = b.question JOIN c USING (k) WHERE c.ids > 1 AND b.id <> c.first_id"""
