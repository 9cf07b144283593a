"""The surrogate views of ``surrogates`` in SQL, joined in front of each check query."""

from __future__ import annotations

from collections.abc import Sequence

_CHROM = "CASE {n} WHEN 0 THEN 'chr7' WHEN 1 THEN 'chr8' WHEN 2 THEN 'chr9' WHEN 3 THEN 'chr1' ELSE 'chr2' END"

VIEWS: dict[str, tuple[str, str]] = {
    "reads": (
        "",
        """
        SELECT 'C' || (user_id % 3) AS condition,
               CASE (event_id // 2) % 3 WHEN 0 THEN 'tis' WHEN 1 THEN 'chx' ELSE 'rna' END AS library,
               (user_id // 3) % 2 + 1 AS rep,
               CASE event_type WHEN 'view' THEN 'chr7' WHEN 'signup' THEN 'chr8'
                    WHEN 'error' THEN 'chr9' WHEN 'purchase' THEN 'chr1' ELSE 'chr2' END AS chrom,
               CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand,
               CAST(floor(floor(epoch(ts) - 1704067200) / 300) AS BIGINT) % 108 * 80 + 5 + (user_id % 2) * (user_id % 7) AS pos
        FROM events""",
    ),
    "track": (
        "reads",
        """
        SELECT condition, library, rep, chrom, strand,
               pos - CASE WHEN strand = '-' AND library <> 'rna' THEN 1 ELSE 0 END AS pos,
               count(*)::DOUBLE AS value
        FROM reads GROUP BY ALL""",
    ),
    "pooled": (
        "track",
        """
        SELECT condition, library, chrom, strand, pos, sum(value) AS value,
               sum(CASE WHEN rep = 1 THEN value ELSE 0 END) AS rep1,
               sum(CASE WHEN rep = 2 THEN value ELSE 0 END) AS rep2
        FROM track GROUP BY ALL""",
    ),
    "exons": (
        "",
        f"""
        SELECT tx, tx // 2 AS gene, {_CHROM.format(n="((tx // 2) % 5)")} AS chrom,
               CASE WHEN (tx // 10) % 2 = 0 THEN '+' ELSE '-' END AS strand,
               ((tx // 2) * 37) % 8000 + 7 * (tx % 2) + 60 * (rank - 1) AS start,
               ((tx // 2) * 37) % 8000 + 7 * (tx % 2) + 60 * (rank - 1) + len AS "end"
        FROM (SELECT l_orderkey AS tx, l_linenumber::BIGINT AS rank,
                     max(l_quantity)::BIGINT AS len
              FROM lineitem GROUP BY ALL)""",
    ),
    "exon_off": (
        "exons",
        """
        SELECT *, coalesce(sum("end" - start) OVER (PARTITION BY tx
                    ORDER BY CASE WHEN strand = '-' THEN -start ELSE start END
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off,
               (sum("end" - start) OVER (PARTITION BY tx))::BIGINT AS length
        FROM exons""",
    ),
    "tx": (
        "exon_off",
        """
        SELECT tx, gene, chrom, strand, min(start) AS start, max("end") AS "end",
               max(length) AS length, max(length) // 5 AS cds_start,
               max(length) // 5 + ((max(length) - max(length) // 5) // 4) * 3 AS cds_end,
               min(CASE WHEN off > 0 THEN off END) AS first_junction, count(*) AS n_exons
        FROM exon_off GROUP BY ALL""",
    ),
    "txtrack": (
        "pooled exon_off",
        """
        SELECT p.condition, p.library, e.tx, e.length,
               e.off + CASE WHEN e.strand = '-' THEN e."end" - 1 - p.pos ELSE p.pos - e.start END AS tx_pos,
               p.value, p.rep1, p.rep2
        FROM pooled p JOIN exon_off e
          ON p.chrom = e.chrom AND p.strand = e.strand AND p.pos >= e.start AND p.pos < e."end" """,
    ),
    "cand": (
        "",
        f"""
        SELECT l_returnflag AS condition, l_orderkey AS transcript_id,
               {_CHROM.format(n="(l_partkey % 5)")} AS chrom,
               CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, l_partkey AS gpos,
               CASE l_partkey % 7 % 5 WHEN 0 THEN 'AUG' WHEN 1 THEN 'AAG' WHEN 2 THEN 'AGG'
                    WHEN 3 THEN 'other_near_cognate' ELSE 'non_cognate' END AS codon_class,
               CASE (l_partkey // 7) % 5 WHEN 0 THEN 'utr5' WHEN 1 THEN 'annotated'
                    WHEN 2 THEN 'cds_inframe' WHEN 3 THEN 'cds_outframe' ELSE 'other' END AS region,
               l_extendedprice AS score, l_quantity AS quantity, l_discount AS discount, l_tax AS tax
        FROM lineitem""",
    ),
    "truth": (
        "cand",
        """
        SELECT condition, chrom, strand,
               CASE WHEN gpos % 11 = 0 THEN gpos + 100000 ELSE gpos END AS gpos,
               max(codon_class) AS codon_class, max(region) AS region,
               max(CASE WHEN tax > 0 THEN CASE WHEN quantity >= 20 THEN 1 ELSE 0 END END) AS r1,
               max(CASE WHEN tax > 0 THEN CASE WHEN discount >= 0.04 THEN 1 ELSE 0 END END) AS r2
        FROM cand GROUP BY ALL""",
    ),
    "labelled": (
        "",
        """
        SELECT transcript_id, mrna_index, transcript_id * 1000000 + mrna_index AS row_idx,
               s / 1050.0::DOUBLE AS score, ((s * 7 + mrna_index) % 1000) / 1000.0::DOUBLE AS score_b,
               y AS label,
               CASE mrna_index % 5 % 3 WHEN 0 THEN 'AUG' WHEN 1 THEN 'near_cognate'
                    ELSE 'non_cognate' END AS codon_class,
               CASE transcript_id % 4 WHEN 2 THEN 'val' WHEN 3 THEN 'test' ELSE 'train' END AS split
        FROM (SELECT l_orderkey // 16 AS transcript_id, l_partkey AS mrna_index,
                     max(floor(l_extendedprice / 100))::BIGINT AS s,
                     max(CASE WHEN l_returnflag = 'R' AND l_linenumber <= 3 THEN 1 ELSE 0 END) AS y
              FROM lineitem GROUP BY ALL)""",
    ),
    "seqs": (
        "",
        """
        SELECT doc_id, regexp_replace(translate(text, 'EIOURSLDNMPBFHVWXYeioursldnmpbfhvwxyacgt',
               'ACGTACGTACGTACGTACACGTACGTACGTACGTACACGT'), '[^ACGT]', '', 'g') AS seq FROM documents""",
    ),
    "counts": (
        "",
        f"""
        SELECT o_orderpriority AS condition, o_orderkey % 2 + 1 AS rep, o_custkey // 10 AS gene,
               {_CHROM.format(n="(o_custkey % 5)")} AS chrom,
               CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
               o_custkey AS gpos, count(*) AS count
        FROM orders GROUP BY ALL""",
    ),
    "shares": (
        "counts",
        """
        SELECT *, count::DOUBLE / nullif(sum(count) OVER (PARTITION BY condition, rep, gene), 0) AS share
        FROM counts""",
    ),
    "gene_counts": (
        "",
        """
        SELECT 'C' || (o_custkey % 3) AS condition, (o_custkey // 3) % 2 + 1 AS rep,
               o_orderkey // 3 AS gene, sum(floor(o_totalprice)::BIGINT % 3)::BIGINT AS count
        FROM orders GROUP BY ALL""",
    ),
    "expression": (
        "gene_counts exons",
        """
        SELECT c.condition, g.gene, g.chrom, g.strand, g.start, g."end",
               coalesce(k.n, 0)::BIGINT AS rna_count, coalesce(k.n, 0) >= 2 AS expressed
        FROM (SELECT DISTINCT condition FROM gene_counts) c
        CROSS JOIN (SELECT gene, chrom, strand, min(start) AS start, max("end") AS "end"
                    FROM exons GROUP BY ALL) g
        LEFT JOIN (SELECT condition, gene, sum(count) AS n FROM gene_counts GROUP BY ALL) k
          ON k.condition = c.condition AND k.gene = g.gene""",
    ),
    "spans": (
        "",
        """
        SELECT o_orderkey AS span_id, o_orderpriority AS chrom,
               date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS start,
               date_diff('day', DATE '1995-01-01', o_orderdate::DATE) + o_custkey % 30 + 1 AS "end"
        FROM orders""",
    ),
    "windows": (
        "reads",
        """
        SELECT DISTINCT chrom, (pos // 256) * 256 AS start, (pos // 256) * 256 + 512 AS "end"
        FROM reads""",
    ),
    "feats": (
        "",
        """
        SELECT vec_id AS row_idx, embedding AS features, label % 2 AS label, label::BIGINT AS class
        FROM embeddings""",
    ),
}


def with_views(names: Sequence[str], sql: str) -> str:
    """``sql`` behind the named views and the views those need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in VIEWS[name][0].split():
            add(need)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    body = sql.strip()
    if not order:
        return body
    head = ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in order)
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
