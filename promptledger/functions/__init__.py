"""Column-expression helpers (no UDFs): text features, money, previews."""
