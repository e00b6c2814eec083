"""How plans are cut, sized and chosen."""
