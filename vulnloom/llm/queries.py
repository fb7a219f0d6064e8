"""The registered corpus queries and their comparison SQL."""

from pyspark.sql import functions as F

from vulnloom.llm import alignment, bpe, collocations, decontaminate, lines, mixing, pii, quality, repetition, secrets, simhash, substrings, toxicity
from vulnloom.llm.common import WORD, ship, table, word_count

QUERIES, ORACLES = {}, {}


def vocabulary(name):
    """Where the installed package of public vocabularies keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name, oracle=None):
    def keep(fn):
        def run(spark, sf_dir):
            ship(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn
    return keep


MIX_SQL = f"""
with rows as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint as k
  from {{documents}}),
sources as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as rk from rows group by source),
ranked as (select *, [3, 1, 2][((rk - 1) % 3 + 1)::int] as weight, 2 * source_size as cap from sources),
levels as (select *, (1.5::double * (sum(source_size) over ())::double - coalesce(sum(cap) over before, 0)::double)
                     / (sum(weight) over () - coalesce(sum(weight) over before, 0))::double as level, cap::double / weight as ratio
           from ranked window before as (order by cap::double / weight, rk rows between unbounded preceding and 1 preceding)),
shares as (select *, (select level from levels where level <= ratio order by ratio, rk limit 1) as share from levels),
targets as (select source, source_size, case when share is null then cap::double else least(cap::double, weight * share) end as target from shares),
lined as (select source, unnest(generate_series(1, cap)) as word, 6 // weight as step, rk from ranked),
given as (select source, max(word) as given from (select *, row_number() over (order by word * step, rk) as place from lined)
          where place <= (select floor(1.5::double * sum(size)) from rows) group by source),
placed as (select r.doc_id, r.size, t.source_size, t.target, coalesce(g.given, 0) as given,
                  (sum(r.size) over (partition by r.source order by k, doc_id nulls last, size rows between unbounded preceding and current row))::bigint - r.size as begin
           from rows r join targets t on r.source is not distinct from t.source left join given g on r.source is not distinct from g.source)
select doc_id, size, source_size, target,
       (greatest(0, least(size, given - begin)) + greatest(0, least(size, given - begin - source_size)))::bigint as taken
from placed"""


@query("op1_mix_to_targets", MIX_SQL.format(documents="documents"))
def op1_mix_to_targets(spark, sf_dir):
    """All documents mixed to the targets of their sources, by weighted fair queueing."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mix_shares(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))


@query("op2_secret_scan")
def op2_secret_scan(spark, sf_dir):
    """Secrets in all documents, by one combined automaton."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


LOW_WORDS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
LEAK_SQL = f"""
with d as (select doc_id, coalesce({LOW_WORDS.format(text='text')}, []) as w from {{documents}}),
b as (select item_id::varchar as item_id, {LOW_WORDS.format(text='text')} as w from benchmark where text is not null),
windows as (select distinct item_id, w[s:s + 9] as win
            from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as s from b where len(w) > 0)),
sizes as (select distinct len(win) as n from windows),
places as (select doc_id, s, n, w[s:s + n - 1] as win
           from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as s from d, sizes where len(w) >= n)),
hits as (select doc_id, item_id, s, n from places join windows using (win)),
covered as (select doc_id, count(distinct p)::bigint as n_hit
            from (select doc_id, unnest(generate_series(s, s + n - 1)) as p from hits) group by doc_id),
items as (select doc_id, count(*)::bigint as n_items, string_agg(item_id, ',' order by item_id) as ids
          from (select distinct doc_id, item_id from hits) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join items using (doc_id)"""


@query("op6_decontaminate", LEAK_SQL.format(documents="documents"))
def op6_decontaminate(spark, sf_dir):
    """Words of all documents that lie in a ten-word window of a benchmark item."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_simhash_near_duplicates")
def op5_simhash_near_duplicates(spark, sf_dir):
    """Groups of all documents whose fingerprints link at two differing bits or fewer."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_repetition_rules")
def op7_repetition_rules(spark, sf_dir):
    """Quality rules on the repetition in all documents, by suffix arrays."""
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


@query("op9_quality_classifier")
def op9_quality_classifier(spark, sf_dir):
    """Quality scores of all documents by attention over their passages."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    """Toxicity scores of all documents by class-conditional Kneser-Ney models."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_personal_data")
def op10_personal_data(spark, sf_dir):
    """Personal data in all documents: base formats, and candidates that boosted trees select."""
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


WINDOW_SQL = f"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) as w from documents),
places as (select doc_id, s, list_aggregate(w[s:s + 19], 'string_agg', ' ') as win
           from (select doc_id, w, unnest(generate_series(1, len(w) - 19)) as s from d where len(w) >= 20)),
firsts as (select doc_id, s, row_number() over (partition by win order by doc_id, s) as n from places),
gone as (select distinct doc_id, p from (select doc_id, unnest(generate_series(s, s + 19)) as p from firsts where n > 1)),
words as (select doc_id, unnest(w) as word, unnest(generate_series(1, len(w))) as p from d),
kept as (select words.doc_id, count(*) filter (gone.p is not null)::bigint as n_removed,
                string_agg(word, ' ' order by words.p) filter (gone.p is null) as kept
         from words left join gone on words.doc_id = gone.doc_id and words.p = gone.p group by words.doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join kept using (doc_id)"""


@query("op3_substring_dedup", WINDOW_SQL)
def op3_substring_dedup(spark, sf_dir):
    """Words of all documents outside repeated windows of twenty words, by suffix trees."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


@query("op4_line_dedup")
def op4_line_dedup(spark, sf_dir):
    """All documents without the lines that repeat earlier ones, exactly or nearly."""
    return lines.dedup_lines(table(spark, sf_dir, "documents"))


PHRASE_SQL = r"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
pieces as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from d)),
places as (select lang, w, m, unnest(generate_series(1, len(w) - m + 1)) as s from pieces, (values (1), (2), (3), (4)) as v(m) where len(w) >= m),
totals as (select lang, sum(len(w))::bigint as n from pieces group by lang),
f as (select lang, m, w[s:s + m - 1] as p, count(*)::bigint as a from places group by all having count(*) >= 30),
cuts as (select c.lang, c.p, c.m, c.a, k, x.a as l, y.a as r, (2000000::hugeint * c.a // (x.a + y.a))::bigint as score
         from (select *, unnest(generate_series(1, m - 1)) as k from f where m > 1) c
         join f x on x.lang = c.lang and x.p = c.p[1:k] join f y on y.lang = c.lang and y.p = c.p[k + 1:c.m]),
cut as (select * from cuts qualify row_number() over (partition by lang, p order by score, k) = 1),
longer as (select lang, p, max(a) as b from (select lang, p[1:m - 1] as p, a from f where m > 2 union all select lang, p[2:m] as p, a from f where m > 2) group by all),
kept as (select c.*, array_to_string(c.p, ' ') as phrase from cut c left join longer g on g.lang = c.lang and g.p = c.p
         where g.b is null or 100::hugeint * g.b < 80::hugeint * c.a)
select lang, rank, phrase, a, l, r, n, score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) join totals using (lang)
where rank <= 2000"""


@query("op11_phrase_collocations", PHRASE_SQL)
def op11_phrase_collocations(spark, sf_dir):
    """The first 2000 collocations of each language, from count streams in prefix and suffix order."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op12_bpe_round_trip")
def op12_bpe_round_trip(spark, sf_dir):
    """All documents encoded by merge rounds and decoded again."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query("op13_tokenizer_alignment")
def op13_tokenizer_alignment(spark, sf_dir):
    """The tokens of two public vocabularies over the same bytes of all documents, linked and counted."""
    files = map(vocabulary, ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), *files)
