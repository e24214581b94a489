"""Data products: marts, dashboards, write-back, plans, metrics, documents."""
