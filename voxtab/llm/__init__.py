"""Operations on training data: filters, duplicates, classifiers, mixing, packing, search.

Nothing else in the package imports this folder.
"""
