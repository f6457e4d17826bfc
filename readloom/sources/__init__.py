"""File formats: FASTQ, SAM, BED, VCF, FASTA and rescaler tables."""
