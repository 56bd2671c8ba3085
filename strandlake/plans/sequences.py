"""Queries over sequences: scans of sequence texts and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seq
from ..sources.views import DNA_SQL, PROT_SQL, dna, prot, table
from .registry import query

COMP = f"translate({{}}, '{seq.IUPAC}', '{seq.IUPAC_COMPLEMENT}')"
AA = "substr('{code}', 16 * (strpos('tcag', substr({c}, 1, 1)) - 1) + 4 * (strpos('tcag', substr({c}, 2, 1)) - 1) + strpos('tcag', substr({c}, 3, 1)), 1)"


def aa_sql(codon: str, code: int = 1) -> str:
    return AA.format(code=seq.code_string(code), c=codon)


@query("SEQ01 SEQ02", f"WITH {DNA_SQL} SELECT doc_id, {COMP.format('dna')} AS comp, reverse(dna) AS rev FROM dna")
def seq_complement_reverse(spark, sf):
    return dna(spark, sf).select("doc_id", seq.complement(F.col("dna")).alias("comp"), F.reverse("dna").alias("rev"))


@query("SEQ03", f"WITH {DNA_SQL} SELECT doc_id, reverse({COMP.format('dna')}) AS rc FROM dna")
def seq_revcomp(spark, sf):
    return dna(spark, sf).select("doc_id", seq.revcomp(F.col("dna")).alias("rc"))


_TRON = f"CASE WHEN substr(dna, p, 3) IN ('agt', 'agc') THEN 'J' WHEN substr(dna, p, 3) = 'tga' THEN 'U' ELSE {aa_sql('substr(dna, p, 3)')} END"


@query("SEQ04 AGG07", f"""
WITH {DNA_SQL} SELECT doc_id, CASE WHEN length(dna) < 3 THEN repeat('-', length(dna)) ELSE '-' || array_to_string(list_transform(range(1, length(dna) - 1), lambda p: {_TRON}), '') || '-' END AS tron FROM dna""")
def seq_tron(spark, sf):
    return dna(spark, sf).select("doc_id", seq.tron(F.col("dna")).alias("tron"))


@query("SEQ05 SEQ10", f"""
WITH {DNA_SQL}, s AS (SELECT doc_id, strand, CASE WHEN strand = '+' THEN dna ELSE reverse({COMP.format('dna')}) END AS s FROM dna, (VALUES ('+'), ('-')) v(strand)),
f AS (SELECT doc_id, strand, CAST(frame AS BIGINT) AS frame, substr(s, frame + 1) AS s FROM s, range(3) r(frame))
SELECT doc_id, strand, frame, array_to_string(list_transform(range(0, length(s) // 3), lambda i: {aa_sql('substr(s, 3 * i + 1, 3)')}), '') AS protein FROM f""")
def seq_translate6(spark, sf):
    both = dna(spark, sf).select("doc_id", F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("dna").alias("s")), F.struct(F.lit("-").alias("strand"), seq.revcomp(F.col("dna")).alias("s")))).alias("x")).select("doc_id", "x.*")
    frames = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("frame"), seq.translate(F.col("s"), i).alias("protein")) for i in range(3)]))
    return both.select("doc_id", "strand", frames.alias("y")).select("doc_id", "strand", "y.*")


@query("SEQ06", f"""
WITH c AS (SELECT a || b || d AS codon FROM (SELECT unnest(['t','c','a','g']) AS a), (SELECT unnest(['t','c','a','g']) AS b), (SELECT unnest(['t','c','a','g']) AS d)),
t AS ({" UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS code, '{seq.code_string(k)}' AS aas" for k in seq.CODES)})
SELECT code, codon, substr(aas, 16 * (strpos('tcag', substr(codon, 1, 1)) - 1) + 4 * (strpos('tcag', substr(codon, 2, 1)) - 1) + strpos('tcag', substr(codon, 3, 1)), 1) AS aa FROM t, c""")
def seq_genetic_codes(spark, sf):
    return spark.createDataFrame([(k, c, a) for k in seq.CODES for c, a in seq.codons(k).items()], "code long, codon string, aa string")


@query("SEQ15 SEQ14 FLT11", """
SELECT doc_id, length(text) - length(replace(text, '-', '')) AS gaps, regexp_replace(lower(text), '[^acgt]', '', 'g') AS plain, regexp_matches(lower(text), '[^acgt]') AS ambiguous FROM documents""")
def seq_gaps_and_ambiguity(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("-"), F.lit("")))).cast("long").alias("gaps"), F.regexp_replace(F.lower("text"), "[^acgt]", "").alias("plain"), F.lower("text").rlike("[^acgt]").alias("ambiguous"))


@query("SEQ12 SRC08", f"""
WITH {DNA_SQL} SELECT doc_id, substr(dna, 11, 50) || substr(dna, 101, 50) AS parts, reverse({COMP.format("substr(dna, 11, 50)")}) AS minus_part FROM dna""")
def seq_slices(spark, sf):
    s = F.col("dna")
    return dna(spark, sf).select("doc_id", F.concat(F.substring(s, 11, 50), F.substring(s, 101, 50)).alias("parts"), seq.revcomp(F.substring(s, 11, 50)).alias("minus_part"))


@query("SEQ11 SNK06", f"""
WITH {DNA_SQL}, e AS (SELECT doc_id, dna, unnest(range(0, length(dna) // 60)) AS i FROM dna)
SELECT doc_id, string_agg(substr(dna, 60 * i + 1, 30), '' ORDER BY i) AS spliced FROM e GROUP BY doc_id""")
def seq_splice(spark, sf):
    """Exons of 30 bases at every 60."""
    parts = F.regexp_extract_all("dna", F.lit("([acgt]{30})[acgt]{30}"), F.lit(1))
    return dna(spark, sf).filter(F.length("dna") >= 60).select("doc_id", F.array_join(parts, "").alias("spliced"))


@query("SNK07 SNK09", f"""
WITH {DNA_SQL} SELECT doc_id, array_to_string(list_transform(range(0, length(dna) // 3), lambda i: {aa_sql('substr(dna, 3 * i + 1, 3)')}), '') AS product FROM dna WHERE length(dna) >= 300""")
def seq_product(spark, sf):
    return dna(spark, sf).filter(F.length("dna") >= 300).select("doc_id", seq.translate(F.col("dna")).alias("product"))


_ORF = """
c AS (SELECT doc_id, frame, i, {aa} AS aa FROM (SELECT doc_id, dna, CAST(frame AS BIGINT) AS frame, unnest(range(0, (length(dna) - frame) // 3)) AS i FROM dna, range(3) r(frame))),
k AS (SELECT *, sum(CASE WHEN aa = '*' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, frame ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM c),
o AS (SELECT doc_id, frame, min(i) AS f, count(*) AS n FROM k WHERE aa <> '*' GROUP BY doc_id, frame, run)"""


@query("SEQ09", f"""
WITH {DNA_SQL}, {_ORF.format(aa=aa_sql('substr(dna, CAST(3 * i + frame + 1 AS BIGINT), 3)'))}
SELECT doc_id, frame, CAST(3 * f + frame + 1 AS BIGINT) AS orf_start, n AS codons FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, frame, f) AS r FROM o) WHERE r = 1""")
def seq_orf_longest(spark, sf):
    """The longest run of codons without a stop in three frames: proteins are split at stops, without any window."""
    frames = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("frame"), seq.translate(F.col("dna"), i).alias("p")) for i in range(3)]))
    runs = dna(spark, sf).select("doc_id", frames.alias("x")).select("doc_id", "x.frame", F.split("x.p", r"\*").alias("r"))
    step = lambda acc, r: F.struct((acc["at"] + F.length(r) + 1).cast("long").alias("at"), F.when(F.length(r) > acc["n"], acc["at"]).otherwise(acc["first"]).alias("first"), F.greatest(acc["n"], F.length(r)).alias("n"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("first"), F.lit(0).alias("n"))
    best = runs.select("doc_id", "frame", F.aggregate("r", zero, step).alias("b")).filter("b.n > 0")
    top = best.groupBy("doc_id").agg(F.min(F.struct((-F.col("b.n")).alias("m"), "frame", F.col("b.first").alias("f"))).alias("t"))
    return top.select("doc_id", F.col("t.frame").alias("frame"), (3 * F.col("t.f") + F.col("t.frame") + 1).alias("orf_start"), (-F.col("t.m")).cast("long").alias("codons"))


@query("SEQ07 SEQ08", f"""
WITH {DNA_SQL}, c AS (SELECT doc_id, unnest(range(1, length(dna) + 1)) AS k, dna FROM dna),
s AS (SELECT doc_id, k, sum(CASE WHEN substr(dna, length(dna) + 1 - k, 1) = 'a' THEN 1 ELSE -5 END) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS score FROM c),
m AS (SELECT *, max(score) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS top FROM s),
e AS (SELECT doc_id, min(CASE WHEN score < greatest(top, 0) - 12 THEN k END) AS stop FROM m GROUP BY doc_id),
b AS (SELECT m.doc_id, min_by(k, (-score, k)) AS tail, max(score) AS score FROM m JOIN e USING (doc_id) WHERE stop IS NULL OR k < stop GROUP BY m.doc_id)
SELECT doc_id, CAST(CASE WHEN score >= 3 THEN tail ELSE 0 END AS BIGINT) AS tail, CAST(greatest(score, 0) AS BIGINT) AS score FROM b""")
def seq_polya_trim(spark, sf):
    """+1 for an a, -5 for another base from the end on; given up 12 below the best."""
    step = lambda s, c: F.when(s["over"], s).otherwise(
        F.struct(
            (s["k"] + 1).alias("k"), (s["sum"] + F.when(c == "a", 1).otherwise(-5)).alias("sum"),
            F.greatest(s["best"], s["sum"] + F.when(c == "a", 1).otherwise(-5)).alias("best"),
            F.when(s["sum"] + F.when(c == "a", 1).otherwise(-5) > s["best"], s["k"] + 1).otherwise(s["at"]).alias("at"),
            (s["sum"] + F.when(c == "a", 1).otherwise(-5) < s["best"] - 12).alias("over"),
        )
    )
    zero = F.struct(F.lit(0).alias("k"), F.lit(0).alias("sum"), F.lit(0).alias("best"), F.lit(0).alias("at"), F.lit(False).alias("over"))
    found = dna(spark, sf).filter(F.length("dna") > 0).select("doc_id", F.aggregate(F.split(F.reverse("dna"), ""), zero, step).alias("s"))
    return found.select("doc_id", F.when(F.col("s.best") >= 3, F.col("s.at")).otherwise(0).cast("long").alias("tail"), F.col("s.best").cast("long").alias("score"))


@query("SEQ17", f"""
WITH {PROT_SQL} SELECT doc_id, translate(prot, 'ACDEFGHIKLMNPQRSTVWY', 'acddfahikiiddkksaiff') AS reduced FROM prot""")
def seq_reduced_alphabet(spark, sf):
    return prot(spark, sf).select("doc_id", F.translate("prot", "ACDEFGHIKLMNPQRSTVWY", "acddfahikiiddkksaiff").alias("reduced"))


@query("SEQ23 SEQ26", f"""
WITH {DNA_SQL}, p AS (SELECT doc_id, dna, unnest(range(1, length(dna) - 3)) AS pos FROM dna WHERE length(dna) >= 5)
SELECT doc_id, pos FROM p WHERE regexp_full_match(substr(dna, pos, 5), '{seq.motif("tnart")}')""")
def seq_motif_sites(spark, sf):
    """Overlapping places of an IUPAC motif: words that match, with their positions."""
    return dna(spark, sf).select("doc_id", F.posexplode(seq.kmers(F.col("dna"), 5)).alias("pos", "word")).filter(F.col("word").rlike(f"^{seq.motif('tnart')}$")).select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"))


# Some restriction enzymes with their sites.
ENZYMES = {"EcoRI": "gaattc", "TaqI": "tcga", "HaeIII": "ggcc", "AluI": "agct", "HinfI": "gantc", "RsaI": "gtac", "MseI": "ttaa", "DraI": "tttaaa"}


@query("SEQ25", f"""
WITH {DNA_SQL}, z(enzyme, site) AS (VALUES {", ".join(f"('{k}', '{seq.motif(v)}')" for k, v in ENZYMES.items())})
SELECT doc_id, enzyme, CAST(len(regexp_extract_all(dna, site)) AS BIGINT) AS sites FROM dna, z WHERE len(regexp_extract_all(dna, site)) BETWEEN 1 AND 20""")
def seq_restriction_sites(spark, sf):
    found = F.explode(F.array(*[F.struct(F.lit(k).alias("enzyme"), F.regexp_count("dna", F.lit(seq.motif(v))).cast("long").alias("sites")) for k, v in ENZYMES.items()]))
    return dna(spark, sf).select("doc_id", found.alias("x")).select("doc_id", "x.*").filter(F.col("sites").between(1, 20))


@query("SEQ24", f"""
WITH {PROT_SQL} SELECT doc_id, CAST(len(regexp_extract_all(prot, '{seq.prosite("[ST]-x(2)-[DE]")}')) AS BIGINT) AS ck2, CAST(len(regexp_extract_all(prot, '{seq.prosite("N-{P}-[ST]-{P}")}')) AS BIGINT) AS nglyc FROM prot""")
def seq_prosite(spark, sf):
    n = lambda p: F.regexp_count("prot", F.lit(seq.prosite(p))).cast("long")
    return prot(spark, sf).select("doc_id", n("[ST]-x(2)-[DE]").alias("ck2"), n("N-{P}-[ST]-{P}").alias("nglyc"))


@query("WIN11", f"""
WITH {DNA_SQL} SELECT doc_id, CAST(s AS BIGINT) AS seg_start, least(s + 200, length(dna)) AS seg_end, substr(dna, s + 1, 200) AS segment
FROM (SELECT doc_id, dna, unnest(range(0, greatest(length(dna) - 180, 1), 20)) AS s FROM dna WHERE length(dna) > 0)""")
def seq_segment_overlap(spark, sf):
    """Segments of 200 bases, each 90 % over the one before."""
    d = dna(spark, sf).filter(F.length("dna") > 0)
    s = d.select("doc_id", "dna", F.explode(F.sequence(F.lit(0), F.greatest(F.length("dna") - 181, F.lit(0)), F.lit(20))).alias("s"))
    return s.select("doc_id", F.col("s").cast("long").alias("seg_start"), F.least(F.col("s") + 200, F.length("dna")).cast("long").alias("seg_end"), F.substring(F.col("dna"), F.col("s") + 1, F.lit(200)).alias("segment"))


@query("SEQ16", """
WITH c AS (SELECT doc_id, unnest(string_split(lower(text), '')) AS ch, unnest(range(1, length(text) + 1)) AS p FROM documents WHERE length(text) > 0)
SELECT doc_id, p AS pos, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS residue_no FROM c WHERE ch IN ('a', 'c', 'g', 't')""")
def seq_coordinate_map(spark, sf):
    """Position in the text of every residue: numbers run over the letters that are left."""
    letters = F.filter(F.transform(F.split(F.lower("text"), ""), lambda c, i: F.struct(c.alias("c"), (i + 1).alias("pos"))), lambda x: x["c"].isin("a", "c", "g", "t"))
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(letters).alias("n", "x"))
    return d.select("doc_id", F.col("x.pos").cast("long").alias("pos"), (F.col("n") + 1).cast("long").alias("residue_no"))


@query("SEQ21", f"""
WITH {DNA_SQL}, j AS (SELECT doc_id, i, substr(dna, 60 * i + 29, 2) || substr(dna, 60 * i + 61, 1) AS codon FROM (SELECT doc_id, dna, unnest(range(0, (length(dna) - 1) // 60)) AS i FROM dna))
SELECT doc_id, CAST(i AS BIGINT) AS junction, codon, {aa_sql('codon')} AS aa FROM j""")
def seq_junction_codons(spark, sf):
    """The codon across each splice of exons of 30 bases at every 60."""
    parts = F.regexp_extract_all("dna", F.lit("[acgt]{28}([acgt]{2})[acgt]{30}(?=([acgt]))"), F.lit(1))
    nexts = F.regexp_extract_all("dna", F.lit("[acgt]{28}([acgt]{2})[acgt]{30}(?=([acgt]))"), F.lit(2))
    j = dna(spark, sf).select("doc_id", F.posexplode(F.zip_with(parts, nexts, lambda a, b: F.concat(a, b))).alias("junction", "codon"))
    return j.select("doc_id", F.col("junction").cast("long").alias("junction"), "codon", seq.amino(F.col("codon")).alias("aa"))


@query("RES10", f"WITH {DNA_SQL} SELECT doc_id, regexp_replace(dna, '(.{{60}})', '\\1' || chr(10), 'g') AS listing FROM dna")
def seq_listing(spark, sf):
    return dna(spark, sf).select("doc_id", F.regexp_replace("dna", "(.{60})", "$1\n").alias("listing"))


@query("SRC01 SRC02", """
SELECT doc_id, CASE WHEN text LIKE '>%' THEN 'fasta' WHEN text LIKE 'LOCUS%' THEN 'genbank' WHEN text LIKE 'ID   %' THEN 'embl' WHEN text LIKE '#NEXUS%' THEN 'nexus' WHEN text LIKE 'The %' THEN 'prose-the' ELSE 'bare' END AS format,
CASE WHEN length(text) = 0 THEN NULL ELSE split_part(text, chr(10), 1) END AS first_line FROM documents""")
def src_sniff_format(spark, sf):
    t = F.col("text")
    kinds = F.when(t.startswith(">"), "fasta").when(t.startswith("LOCUS"), "genbank").when(t.startswith("ID   "), "embl").when(t.startswith("#NEXUS"), "nexus").when(t.startswith("The "), "prose-the").otherwise("bare")
    return table(spark, sf, "documents").select("doc_id", kinds.alias("format"), F.when(F.length(t) > 0, F.split_part(t, F.lit("\n"), F.lit(1))).alias("first_line"))


@query("SRC03", """
WITH h AS (SELECT doc_id, substr(regexp_replace(lower(text), '[^a-z]', '', 'g'), 1, 1000) AS h FROM documents)
SELECT doc_id, CASE WHEN length(h) = 0 THEN 'unknown' WHEN length(regexp_replace(h, '[^acgtun]', '', 'g')) >= 0.75 * length(h) THEN 'dna' WHEN length(regexp_replace(h, '[^jou]', '', 'g')) >= 0.05 * length(h) THEN 'tron' ELSE 'protein' END AS molecule FROM h""")
def src_infer_molecule(spark, sf):
    """The feature itself looks at the first 1000 letters."""
    h = table(spark, sf, "documents").select("doc_id", F.substring(F.regexp_replace(F.lower("text"), "[^a-z]", ""), 1, 1000).alias("h"))
    n, share = F.length("h"), lambda letters: F.length(F.regexp_replace("h", f"[^{letters}]", ""))
    return h.select("doc_id", F.when(n == 0, "unknown").when(share("acgtun") >= 0.75 * n, "dna").when(share("jou") >= 0.05 * n, "tron").otherwise("protein").alias("molecule"))


@query("SRC05", f"WITH {DNA_SQL} SELECT doc_id, length(dna) AS residues FROM dna WHERE doc_id BETWEEN 10 AND 60")
def src_entry_range(spark, sf):
    return dna(spark, sf).filter(F.col("doc_id").between(10, 60)).select("doc_id", F.length("dna").cast("long").alias("residues"))


@query("SRC06 RES14", f"WITH {DNA_SQL} SELECT d.doc_id, l.quality, length(dna) AS residues FROM dna d JOIN labels l ON d.doc_id = l.doc_id")
def src_catalog_scan(spark, sf):
    return dna(spark, sf).join(table(spark, sf, "labels"), "doc_id").select("doc_id", F.col("quality").cast("long").alias("quality"), F.length("dna").cast("long").alias("residues"))


@query("SRC07", f"WITH {DNA_SQL} SELECT doc_id, dna FROM dna WHERE doc_id = 7")
def src_point_lookup(spark, sf):
    return dna(spark, sf).filter("doc_id = 7").select("doc_id", "dna")


@query("SRC15", f"WITH {DNA_SQL} SELECT doc_id, '>' || lang || '_' || doc_id || chr(10) || dna AS fasta FROM dna".replace("lang ||", "coalesce(lang, 'na') ||"))
def src_to_fasta(spark, sf):
    return dna(spark, sf).select("doc_id", F.concat(F.lit(">"), F.coalesce("lang", F.lit("na")), F.lit("_"), "doc_id", F.lit("\n"), "dna").alias("fasta"))


@query("SRC16", """
SELECT doc_id, CASE WHEN regexp_matches(lower(text), '5''? ?end|forward|sense') THEN '+' WHEN regexp_matches(lower(text), '3''? ?end|reverse|anti') THEN '-' ELSE '?' END AS strand FROM documents""")
def src_strand_phrase(spark, sf):
    t = F.lower("text")
    return table(spark, sf, "documents").select("doc_id", F.when(t.rlike("5'? ?end|forward|sense"), "+").when(t.rlike("3'? ?end|reverse|anti"), "-").otherwise("?").alias("strand"))


@query("AGG35 RES11", f"WITH {DNA_SQL} SELECT coalesce(lang, 'na') AS lang, count(*) AS sequences, CAST(sum(length(dna)) AS BIGINT) AS residues FROM dna GROUP BY 1")
def src_total_residues(spark, sf):
    return dna(spark, sf).groupBy(F.coalesce("lang", F.lit("na")).alias("lang")).agg(F.count("*").alias("sequences"), F.sum(F.length("dna")).alias("residues"))


@query("RES16", "SELECT substr(source, 1, 8) AS species, lang, count(*) AS entries FROM documents GROUP BY 1, 2")
def src_species_routing(spark, sf):
    return table(spark, sf, "documents").groupBy(F.substring("source", 1, 8).alias("species"), "lang").agg(F.count("*").alias("entries"))


@query("RES17", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def src_missing_ids(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("RES07", f"""
WITH c AS (SELECT a || b || d AS codon FROM (SELECT unnest(['t','c','a','g']) AS a), (SELECT unnest(['t','c','a','g']) AS b), (SELECT unnest(['t','c','a','g']) AS d))
SELECT {aa_sql('codon')} AS aa, string_agg(codon, ',' ORDER BY codon) AS codons FROM c GROUP BY 1""")
def seq_inverse_translation(spark, sf):
    return seq_genetic_codes(spark, sf).filter("code = 1").groupBy("aa").agg(F.array_join(F.array_sort(F.collect_list("codon")), ",").alias("codons"))


@query("RES12", """
SELECT i, j, CAST(j * (j - 1) // 2 + i AS BIGINT) AS elem FROM (SELECT doc_id AS j FROM documents), LATERAL (SELECT unnest(range(0, j % 50)) AS i)""".replace("SELECT i, j", "SELECT CAST(i AS BIGINT) AS i, j"))
def pair_index(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("j")).filter("j % 50 > 0")
    p = d.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("j") % 50 - 1)))
    return p.select("i", "j", F.floor(F.col("j") * (F.col("j") - 1) / 2 + F.col("i")).alias("elem"))


@query("SEQ18 JON01", f"""
WITH {DNA_SQL}, w AS (SELECT doc_id, substr(dna, p, 1) || substr(dna, p + 1, 1) || substr(dna, p + 3, 1) || substr(dna, p + 5, 1) AS word FROM (SELECT doc_id, dna, unnest(range(1, length(dna) - 4)) AS p FROM dna WHERE length(dna) >= 6))
SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w GROUP BY word""")
def kmer_spaced_seed(spark, sf):
    """The pattern 110101 over words of six."""
    w = dna(spark, sf).select("doc_id", F.explode(seq.kmers(F.col("dna"), 6)).alias("k"))
    w = w.select("doc_id", F.concat(F.substring("k", 1, 2), F.substring("k", 4, 1), F.substring("k", 6, 1)).alias("word"))
    return w.groupBy("word", "doc_id").count().groupBy("word").agg(F.sum("count").alias("n"), F.count("*").alias("docs"))
