"""Training-data pipeline operators: each module holds one operator, ``queries.py`` registers them."""
