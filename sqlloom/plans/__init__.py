"""What Catalyst knows of a statement: contracts and plan lint."""
