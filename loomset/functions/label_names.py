"""Class names of the two public single-label data sets, by label id."""

from __future__ import annotations

# Label ids are positions in these lists.
DBPEDIA_14 = [
    "Company", "EducationalInstitution", "Artist", "Athlete", "OfficeHolder", "MeanOfTransportation", "Building",
    "NaturalPlace", "Village", "Animal", "Plant", "Album", "Film", "WrittenWork",
]
CIFAR_10 = ["airplane", "automobile", "bird", "cat", "deer", "dog", "frog", "horse", "ship", "truck"]


def by_id(names: list[str]) -> dict[int, str]:
    return dict(enumerate(names))
