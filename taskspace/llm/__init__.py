"""Training-data operators: each module holds one operator; nothing else in the package imports this subpackage."""
