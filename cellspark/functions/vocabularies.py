"""Static vocabularies as dimension rows: terms that complete label hierarchies, and names of coarse groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Terms that are added to labels for a better hierarchy, by their names.
ADDED_TERMS = {
    "assay_ontology_term_id": {
        "10x transcription profiling": "EFO:0030003",
        "spatial transcriptomics": "EFO:0008994",
        "10x 3' transcription profiling": "EFO:0030003",
        "10x 5' transcription profiling": "EFO:0030004",
    },
    "disease_ontology_term_id": {
        "metabolic disease": "MONDO:0005066",
        "chronic kidney disease": "MONDO:0005300",
        "chromosomal disorder": "MONDO:0019040",
        "infectious disease": "MONDO:0005550",
        "inflammatory disease": "MONDO:0021166",
        "disorder of development or morphogenesis": "MONDO:0021147",
        "mitochondrial disease": "MONDO:0044970",
        "psychiatric disorder": "MONDO:0002025",
        "cancer or benign tumor": "MONDO:0002025",
        "neoplasm": "MONDO:0005070",
    },
    "cell_type_ontology_term_id": {
        "progenitor cell": "CL:0011026",
        "hematopoietic cell": "CL:0000988",
        "myoblast": "CL:0000056",
        "myeloid cell": "CL:0000763",
        "neuron": "CL:0000540",
        "electrically active cell": "CL:0000211",
        "epithelial cell": "CL:0000066",
        "secretory cell": "CL:0000151",
        "stem cell": "CL:0000034",
        "non-terminally differentiated cell": "CL:0000055",
        "supporting cell": "CL:0000630",
    },
}

# Names of coarse groups.
COARSE_GROUPS = {
    "tissue": (
        "adipose tissue",
        "bladder organ",
        "blood",
        "bone marrow",
        "brain",
        "breast",
        "esophagus",
        "eye",
        "embryo",
        "fallopian tube",
        "gall bladder",
        "heart",
        "intestine",
        "kidney",
        "liver",
        "lung",
        "lymph node",
        "musculature of body",
        "nose",
        "ovary",
        "pancreas",
        "placenta",
        "skin of body",
        "spinal cord",
        "spleen",
        "stomach",
        "thymus",
        "thyroid gland",
        "tongue",
        "uterus",
    ),
    "ancestry": (
        "African",
        "Chinese",
        "East Asian",
        "Eskimo",
        "European",
        "Greater Middle Eastern  (Middle Eastern, North African or Persian)",
        "Hispanic or Latin American",
        "Native American",
        "Oceanian",
        "South Asian",
    ),
    "development_stage": (
        "Embryonic human",
        "Fetal",
        "Immature",
        "Mature",
    ),
    "assay": (
        "10x 3'",
        "10x 5'",
        "10x multiome",
        "CEL-seq2",
        "Drop-seq",
        "GEXSCOPE technology",
        "inDrop",
        "microwell-seq",
        "sci-Plex",
        "sci-RNA-seq",
        "Seq-Well",
        "Slide-seq",
        "Smart-seq",
        "SPLiT-seq",
        "TruDrop",
        "Visium Spatial Gene Expression",
    ),
}


def dimension_rows(spark: SparkSession) -> DataFrame:
    """``vocabulary`` (a label, or "coarse_" and a group), ``name`` and ``ontology_id`` (null for names of coarse groups), a row for each entry."""
    added = [(label, name, term) for label, terms in ADDED_TERMS.items() for name, term in terms.items()]
    coarse = [(f"coarse_{group}", name, None) for group, names in COARSE_GROUPS.items() for name in names]
    return spark.createDataFrame(added + coarse, "vocabulary string, name string, ontology_id string")
