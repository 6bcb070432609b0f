"""DataFrame operators: writes, pages, prices, names, tables, rules, scores, status."""
