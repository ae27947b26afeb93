"""Live processing."""
